"""Quality classifier: a sparse rule ensemble.

Boosted trees are fitted on text statistics of a bounded sample of labelled rows.
Every path from a root to a node is a rule, a conjunction of bounds on
statistics.  Lasso logistic regression over the rules keeps few of them, and the
model is compiled into one Spark column expression, so scoring whole texts runs
in the JVM without user functions.

Training reads at most ``MAX_TRAINING_ROWS`` labelled rows (those of smallest id
hash; a documented bound), and never a row that is held out.  Labels, language,
source and id are no inputs of a score.

Null and empty texts are scored by their statistics like any other; repeated
rows get repeated results; an empty table gives no rows; without labels the
score is 0.5, with labels of one class their smoothed share; labels that are null
are ignored; of contradicting labels of one id the larger counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.textstats import with_counts

MAX_TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO = 8, 3, 0.002
STATISTICS = {
    "log_words": "ln(1 + n_words)",
    "mean_word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "duplicate_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_ratio": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


class Bound(NamedTuple):
    """One condition of a rule: statistic <= value, or > value."""

    statistic: str
    below: bool
    value: float

    def sql(self) -> str:
        return f"{self.statistic} {'<=' if self.below else '>'} {self.value!r}D"

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.statistic] <= self.value) == self.below


class RuleModel(NamedTuple):
    """Weighted rules; ``compile`` gives the score as a column over the statistics."""

    intercept: float
    rules: list[tuple[tuple[Bound, ...], float]]

    def compile(self) -> Column:
        terms = [f"{self.intercept!r}D"]
        for bounds, weight in self.rules:
            terms.append(f"CASE WHEN {' AND '.join(b.sql() for b in bounds)} THEN {weight!r}D ELSE 0.0D END")
        return F.expr(f"1.0D / (1.0D + exp(-({' + '.join(terms)})))")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    counted = with_counts(docs.select(F.col(id_col), F.col(text_col)), text_col, (id_col,))
    return counted.select(id_col, *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in STATISTICS.items()])


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality") -> list[tuple[dict[str, float], int]]:
    """Statistics and labels of the training sample, on the driver (bounded by ``max_rows``)."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
             .orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    mine = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(known), "__id")
    found = with_statistics(mine.select(F.struct("__id", "__label").alias("__key"), "__t"), "__key", "__t")
    rows = found.select("__key.*", *STATISTICS).dropDuplicates(["__id"]).orderBy("__id").limit(max_rows).collect()
    return [({n: row[n] for n in STATISTICS}, int(row["__label"])) for row in rows]


def _paths(node, names: list[str], above: tuple[Bound, ...] = ()) -> list[tuple[Bound, ...]]:
    """Rules of all nodes below the root of a fitted tree."""
    found = [above] if above else []
    if node.numDescendants():
        name, value = names[node.split().featureIndex()], float(node.split().threshold())
        found += _paths(node.leftChild(), names, (*above, Bound(name, True, value)))
        found += _paths(node.rightChild(), names, (*above, Bound(name, False, value)))
    return found


def fit_rules(spark, rows: list[tuple[dict[str, float], int]], trees: int = TREES, depth: int = DEPTH,
              lasso: float = LASSO, seed: int = 11) -> RuleModel:
    """Trees, their paths as rules, lasso weights over the rules."""
    import math

    ones = sum(label for _, label in rows)
    if not 0 < ones < len(rows):
        share = (ones + 1) / (len(rows) + 2)
        return RuleModel(math.log(share / (1 - share)), [])
    names = list(STATISTICS)
    data = spark.createDataFrame([(float(y), Vectors.dense([x[n] for n in names])) for x, y in rows],
                                 ["label", "features"]).coalesce(2)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(data)
    rules = []
    for tree in boosted.trees:
        rules += _paths(tree._java_obj.rootNode(), names)
    rules = sorted(set(rules))
    marked = spark.createDataFrame(
        [(float(y), Vectors.dense([float(all(b.holds(x) for b in rule)) for rule in rules])) for x, y in rows],
        ["label", "features"]).coalesce(2)
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(marked)
    weights = fitted.coefficients.toArray().tolist()
    return RuleModel(float(fitted.intercept), [(r, w) for r, w in zip(rules, weights) if w])


def score(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``held_out``, ``score`` (0 to 1) and ``predicted``."""
    return (with_statistics(docs, id_col, text_col).withColumn("score", model.compile())
            .select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def keep_predicted_good(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model calls good, with all their columns, in one pass without a join."""
    whole = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__body"))
    return with_statistics(whole, "__row", "__body").where(model.compile() >= 0.5).select("__row.*")
