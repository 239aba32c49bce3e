"""Registered queries of the operators, with their SQL where SQL can state them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelgrid.llm.chat import format_chats
from parcelgrid.llm.digest_runs import exact_duplicates
from parcelgrid.llm.kmeans_tree import nearest_neighbours
from parcelgrid.llm.merge_automaton import encode_decode
from parcelgrid.llm.merge_counts import count_tokens
from parcelgrid.llm.mixing import mix
from parcelgrid.llm.phrases import mine_phrases
from parcelgrid.llm.quality_rules import RULES, judge
from parcelgrid.llm.rule_ensemble import fit_rules, score, training_rows
from parcelgrid.llm.sharding import assign_shards
from parcelgrid.llm.simhash import simhash_components
from parcelgrid.llm.subvector_kmeans import cluster_vectors
from parcelgrid.llm.textstats import ALL_STOP_WORDS, STOP_WORDS, SYMBOLS
from parcelgrid.llm.warc import archive_and_read
from parcelgrid.session import ensure_checkpoint_dir, table

N_SHARDS = 8
TOKEN_LIMIT = 2048
PHRASE_THRESHOLD, PHRASES_A_LANG = 100, 2000
CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED, DIMENSIONS = 8, 10, 3, 64


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), N_SHARDS, scratch_folder(spark, "slot-map"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op3_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_rules(spark, training_rows(docs, table(spark, sf_dir, "labels"))))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), TOKEN_LIMIT)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(table(spark, sf_dir, "pages"), scratch_folder(spark, "warc"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"), PHRASE_THRESHOLD, PHRASES_A_LANG)


def op12_subvector_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"), CLUSTERS, CLUSTER_ROUNDS, CLUSTER_SEED, DIMENSIONS)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


LLM_QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_mixing, op3_bpe_automaton, op4_quality_rules, op5_chat_formatting, op6_nearest_neighbours,
    op7_rule_ensemble, op8_simhash, op9_token_counts, op10_warc, op11_phrases, op12_subvector_kmeans,
    op13_exact_dedup)}


def quality_sql(source: str = "documents") -> str:
    """All rows of ``source`` with the counts of the quality rules, ``base_failed`` and ``kept``."""
    symbols = "".join("\\" + s if s in "$|*" else s for s in SYMBOLS)
    stops = ", ".join(f"'{w}'" for w in ALL_STOP_WORDS)
    languages = ", ".join(f"'{x}'" for x in STOP_WORDS)
    listed = f"coalesce(lower(regexp_extract(lang, '^[A-Za-z]*')) IN ({languages}), FALSE)"
    rules = []
    for r in RULES:
        enough = f"{r.numerator} >= {r.least}::DOUBLE * {r.denominator}"
        rules += [f"(NOT {listed} OR {enough})" if r.only_listed else enough] if r.least is not None else []
        rules += [f"{r.numerator} <= {r.most}::DOUBLE * {r.denominator}"] if r.most is not None else []
    return rf"""
WITH t AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS body FROM {source}),
w AS (SELECT rid, regexp_extract_all(body, '[^ \t-\r]+') AS ws,
        list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) AS ls,
        length(body) - length(regexp_replace(body, '[{symbols}]', '', 'g')) AS n_symbols FROM t),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
counts AS (SELECT t.* EXCLUDE (body), len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
        len(list_filter(ws, lambda x: list_contains([{stops}], lower(x)))) AS n_stop_words,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM t JOIN w USING (rid) LEFT JOIN rep USING (rid)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT *, NOT base_failed AND {' AND '.join(rules)} AS kept FROM base"""


def phrases_sql(threshold: int = PHRASE_THRESHOLD, top: int = PHRASES_A_LANG) -> str:
    return rf"""
WITH low AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
parts AS (SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?
-
]')) AS part FROM low),
pieces AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(part, '[^ 	]+') AS ws FROM parts),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
sized AS (SELECT lang, ws, unnest(generate_series(1, 5)) AS size FROM pieces),
grams AS (SELECT lang, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM sized WHERE len(ws) >= size),
f AS (SELECT lang, size, ws[i:i + size - 1] AS p, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {threshold}),
cuts AS (SELECT lang, size, p, f AS a, unnest(generate_series(1, size - 1)) AS k FROM f WHERE size > 1),
scored AS (SELECT c.lang, c.size, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n,
    CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
  JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (SELECT lang, size, p, f, unnest(generate_series(2, size - 1)) AS s FROM f WHERE size > 2),
spots AS (SELECT lang, p, f, s, unnest(generate_series(1, size - s + 1)) AS i FROM longer),
inside AS (SELECT lang, p[i:i + s - 1] AS p, max(f) AS above FROM spots GROUP BY ALL),
kept AS (SELECT w.lang, array_to_string(w.p, ' ') AS phrase, a, l, r, n, score FROM weakest w
  LEFT JOIN inside i ON i.lang = w.lang AND i.p = w.p WHERE above IS NULL OR 100 * above < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= {top}"""


def clusters_sql(k: int = CLUSTERS, rounds: int = CLUSTER_ROUNDS, seed: int = CLUSTER_SEED, dims: int = DIMENSIONS) -> str:
    def nearest(centroids: str) -> str:
        return f"""
SELECT rid, vec_id, x, min(struct_pack(d := list_sum(list_transform(range(1, {dims + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))),
    cluster := cluster)) AS best FROM v, {centroids} GROUP BY rid, vec_id, x"""

    steps = []
    for n in range(rounds):
        steps.append(f"""
a{n} AS MATERIALIZED ({nearest(f'c{n}')}),
s{n} AS (SELECT best.cluster AS cluster, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS m
  FROM a{n}, (SELECT unnest(range(1, {dims + 1})) AS i) GROUP BY ALL),
m{n} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m.c, o.c) AS c FROM c{n} o LEFT JOIN m{n} m USING (cluster)),""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda y: CAST(floor(1024 * y::DOUBLE) AS BIGINT)) AS x, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), embedding) - 1 AS cluster, x AS c
  FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),{''.join(steps)}
last AS MATERIALIZED ({nearest(f'c{rounds}')})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance,
  CAST(sum(best.d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, best, best.cluster AS cluster FROM last) JOIN c{rounds} USING (cluster)"""


LLM_ORACLES = {
    "op11_phrases": phrases_sql(),
    "op12_subvector_kmeans": clusters_sql(),
    "op13_exact_dedup": r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[ 	-
]', '', 'g') AS body FROM documents),
r AS (SELECT *, first_value(doc_id) OVER same AS keep_id, first_value(rid) OVER same AS keep_rid,
    count(*) OVER (PARTITION BY body) AS group_size
  FROM t WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST, rid))
SELECT doc_id, keep_id, group_size, rid = keep_rid AS kept, sha256(body) AS text_sha256 FROM r""",
    "op4_quality_rules": f"""
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, kept FROM ({quality_sql()})""",
    "op5_chat_formatting": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
p AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
    list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS so_far FROM t),
whole AS (SELECT so_far, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY so_far, n)
SELECT conv_id, CAST(n AS INTEGER) AS n_turns, n_copies,
  array_to_string(list_transform(so_far, lambda x: '<|im_start|>' || x.r || chr(10) || x.t || '<|im_end|>' || chr(10)), '')
    AS rendered
FROM whole WHERE so_far NOT IN (SELECT so_far FROM p WHERE pos < n)""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h,
    max(page_id) OVER (PARTITION BY body) AS largest FROM p),
hexed AS (SELECT *, list_transform(generate_series(1, 40), lambda i: instr('0123456789abcdef', h[i]) - 1) AS nib FROM d),
bits AS (SELECT *, list_transform(generate_series(0, 159),
    lambda i: (nib[i // 4 + 1] >> (3 - i % 4)) & 1) AS b FROM hexed)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
    16 * b[5 * k + 1] + 8 * b[5 * k + 2] + 4 * b[5 * k + 3] + 2 * b[5 * k + 4] + b[5 * k + 5] AS INTEGER), 1)), '')
    AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to FROM bits""",
}
