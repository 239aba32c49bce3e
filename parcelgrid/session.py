"""Session helpers shared by tests, the bench and the query bindings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on: AQE re-plans joins at run time (it turns a
# shuffled join into a broadcast only when the measured side is small, and
# splits skewed partitions), and a fixed UTC zone keeps timestamps comparable.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.variant.allowDuplicateKeys": "true",  # LAST_KEY_WINS
}


LAST_KEY_WINS = "spark.sql.variant.allowDuplicateKeys"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Give a session that was not built here the setting its JSON parses rely on:
    of a repeated key the last value counts, as in Python."""
    spark.conf.set(LAST_KEY_WINS, "true")
    return spark


def check_last_key_wins(spark: SparkSession | None = None) -> None:
    """Parsing helpers check the setting and change nothing: they may only build a plan."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(LAST_KEY_WINS, "false").lower() != "true":
        raise RuntimeError(f"this parse needs {LAST_KEY_WINS}=true: call parcelgrid.session.prepare_session(spark)")


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "parcelgrid") -> SparkSession:
    """Local session for tests and the bench (clusters bring their own)."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("PARCELGRID_DRIVER_MEM", "8g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names shared storage and is used as given.  Only
    when it is unset on a local master (tests, the bench) a scratch folder is
    created and registered; a cluster without the setting is an error, since a
    machine-local folder is not shared by the executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="parcelgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables, in a session prepared for this library's parses."""
    return prepare_session(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
