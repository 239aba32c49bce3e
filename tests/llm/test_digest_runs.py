"""Exact deduplication against plain grouping."""

import hashlib
import random
import re

import pytest

from parcelgrid.llm import digest_runs as D


def plain(rows):
    """(id, keep_id, group_size, text_sha256) of every row, and the number of rows kept."""
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[ \t-\r]", "", text or ""), []).append((-len(text or ""), i is None, i or 0, i))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: m[:3])[3]
        sha = hashlib.sha256(body.encode()).hexdigest()
        out += [(m[3], keep, len(members), sha) for m in members]
    return out, len(groups)


def check(rows, got):
    key = lambda r: tuple((x is None, x or 0) for x in r[:3]) + r[3:]
    want, n_groups = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    kept = [r for r in got if r.kept]
    assert len(kept) == n_groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


ODD = [(1, "a b"), (2, "ab"), (3, " a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "a b"), (8, "a\x1cb"), (9, "AB"),
       (None, "only me"), (None, "a  b   "), (None, "n"), (None, "n"), (7, "a b"), (7, "other of id 7"),
       (10, "x" * 300_000 + " y"), (11, "x" * 300_000 + "y"), (12, "é e"), (13, "ée"), (14, "é e")]


@pytest.mark.parametrize("fan_in, per_run", [(2, 30), (4, 100), (8, 10), (8, 1000)])
def test_against_plain_groups(spark, docs_of, fan_in, per_run):
    rng = random.Random(fan_in * per_run)
    rows = [(k, rng.choice(["same text", f"t {k % 90}", f"own{k}"]) + " " * rng.randint(0, 3)) for k in range(400)] + ODD
    rng.shuffle(rows)
    got = D.exact_duplicates(docs_of(rows).repartition(7), fan_in=fan_in, rows_per_run=per_run)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check(rows, got.collect())


def test_empty_table_and_repeated_rows(spark, docs_of):
    docs = docs_of([(1, "a"), (1, "a"), (1, "a")])
    assert D.exact_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.kept for r in D.exact_duplicates(docs).collect()) == [False, False, True]
    with pytest.raises(ValueError):
        D.exact_duplicates(docs, fan_in=6)


def test_a_hot_text_is_one_row_per_run(spark):
    docs = spark.range(0, 20_000, 1, 16).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot one' ELSE 't' || id END AS text")
    rows = D.digest_rows(docs).withColumn("copies", D.F.lit(1).cast("long"))
    per_run = D.sorted_run(rows).where("copies > 1").collect()
    assert len(per_run) == 16 and sum(r.copies for r in per_run) == 6667  # what the first exchange moves of it
    merged = D.merge_runs(D.digest_rows(docs), fan_in=4, rows_per_run=2000)
    assert [(r.id, r.copies) for r in merged.where("copies > 1").collect()] == [(0, 6667)]
    assert merged.count() == 20_000 - 6666


def test_equal_short_digests_are_verified(spark):
    """Rows with one 64-bit digest but other SHA-256 or length are not merged."""
    rows = spark.createDataFrame([(i, 1, i, 7, bytes([i % 2]) * 32, 3 + i // 8) for i in range(16)],
                                 "id long, points long, row long, digest long, sha binary, n_chars int").repartition(4)
    got = D.merge_runs(rows, fan_in=2, rows_per_run=4).collect()
    assert sorted((r.id, r.copies) for r in got) == [(0, 4), (1, 4), (8, 4), (9, 4)]
