"""Phrase mining against plain counting."""

import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from parcelgrid.llm import phrases as P

TYPE = "doc_id long, text string, lang string, phrase string, n string, words int, score int"


def pieces(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^ \t]+", part) for part in re.split(r"[.,;:!?\n-\r]", lower)]


def plain_counts(rows):
    counts, n = {}, Counter()
    for _, text, lang in rows:
        for words in pieces(text):
            n[lang or "und" if lang is None else lang] += len(words)
            own = counts.setdefault("und" if lang is None else lang, Counter())
            for size in range(1, 6):
                own.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    return counts, n


def plain(rows, threshold, top):
    counts, n = plain_counts(rows)
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        scored = []
        for p, a in found.items():
            score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and f >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, f in found.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n_docs=160):
    rng = random.Random(seed)
    names = ["New York City hall", "in the year of", "a a a a", "Ünder the sea", "x-ray\x1cvision kit", "of the"]
    small = ["the", "of", "And", "to", "a", "sea", "New", "york", "9", "a b"]
    rows = []
    for k in range(n_docs):
        words = [rng.choice(names if rng.random() < 0.4 else small) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\t", "  ", ". ", ",", "\n", "\r\n", " ! "]) if rng.random() < 0.3 else w + " " for w in words)
        rows.append((k, text, rng.choice(["en", "de", None, "und"])))
    return rows + [(None, None, "en"), (1, "", None), (2, " . ,", "fr"), (3, "lone", "xx"), (5, "a " * 5000, "en")]


@pytest.mark.parametrize("shards, block_words, cells, parts", [(4, 300, 1 << 16, 3), (3, 90, 16, 5), (1, 1 << 20, 1 << 10, 1)])
def test_against_plain_counts(spark, shards, block_words, cells, parts):
    """16 cells: nearly every phrase passes the filter by mistake, and the counts stay exact."""
    rows = corpus(shards)
    docs = spark.createDataFrame([(i, t, g, "x", "y", 1, 2) for i, t, g in rows], TYPE).repartition(parts)
    got = P.mine_phrases(docs, threshold=12, top=25, shards=shards, block_words=block_words, cells=cells)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 12, 25)
    assert len(want) > 25 and sorted(map(tuple, got.collect())) == want


def test_all_counts_are_exact_wherever_a_phrase_begins(spark, scratch):
    """Phrases that stand in the last shards only, or in one shard only, get whole counts."""
    rows = [(k, "common words here " * 4 + ("late phrase comes last " * 3 if k >= 30 else "early bird only " if k < 8 else ""), "en")
            for k in range(40)]
    docs = spark.createDataFrame([(*r, "", "", 0, 0) for r in rows], TYPE).coalesce(1)
    P.write_shards(docs, scratch + "/shards", 4, block_words=100)
    found = P.count_phrases(scratch + "/shards", spark, scratch + "/counts", 10, 4, 1 << 12)
    got = {tuple(bytes(r.phrase).decode().split()): r.n for r in found.collect()}
    counts, _ = plain_counts(rows)
    want = {p: n for p, n in counts["en"].items() if n >= 10}
    assert got == want and found.count() == len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "", "", 0, 0)], TYPE)
    assert P.mine_phrases(docs.limit(0)).count() == 0
    assert P.mine_phrases(docs).count() == 0  # nothing at the threshold
    assert P.mine_phrases(docs.selectExpr("cast(null as string) AS text", "cast(null as string) AS lang")).count() == 0


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("en", b"a", 1, 4 * 10 ** 12), ("en", b"b", 1, 3 * 10 ** 12), ("en", b"a b", 2, 2 * 10 ** 12)],
                                   "lang string, phrase binary, length int, n long")
    n = spark.createDataFrame([("en", 9 * 10 ** 15)], "lang string, n long")
    row = P.collocations(counts, n).first()
    assert row.score == 1000 * 2 * 10 ** 12 * 9 * 10 ** 15 // (12 * 10 ** 24) and (row.l, row.r) == (4 * 10 ** 12, 3 * 10 ** 12)


def test_filter_passes_a_phrase_for_a_full_cycle():
    known, rng = P.PhraseFilter(64), np.random.default_rng(4)
    hashes = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    first = {}
    for step in range(12):
        for k, last in enumerate(P.last_step(known.reached[0], hashes)):
            if last:
                first.setdefault(k, step)
                assert last >= first[k]
        for place in P.filter_places(hashes[3 * step:3 * step + 3], 64):
            known.reached[0, place] = step + 1


def test_only_open_phrases_go_from_step_to_step(spark, scratch):
    """A phrase that no shard holds often enough to reach the threshold is in no written table."""
    rows = [(k, f"often said words here own{k} own{k}b. " + "rare pair " * (k % 9 == 0), "en") for k in range(120)]
    docs = spark.createDataFrame([(*r, "", "", 0, 0) for r in rows], TYPE).repartition(3)
    P.write_shards(docs, scratch + "/shards", 3, block_words=80)
    found = P.count_phrases(scratch + "/shards", spark, scratch + "/counts", 60, 3, 1 << 12)
    assert {bytes(r.phrase).decode() for r in found.collect()} == {
        "often", "said", "words", "here", "often said", "said words", "words here", "often said words", "said words here",
        "often said words here"}
    last = spark.read.parquet(scratch + "/counts/open-0").count() + spark.read.parquet(scratch + "/counts/open-1").count()
    assert last <= 20  # 240 own words and their pairs never opened


def test_shards_take_less_disk_than_the_texts(spark, scratch):
    """What a scan can make again from the words is not written, and the rest compresses."""
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 12))) for _ in range(20_000)]
    often = [1 / (k + 3) for k in range(len(words))]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(words, often, k=400)), "en", "", "", 0, 0) for k in range(400)],
                                 TYPE).coalesce(1)
    docs.select("text", "lang").write.option("compression", "zstd").parquet(scratch + "/texts")
    P.write_shards(docs, scratch + "/shards", 2, block_words=80_000)
    size = {name: sum(f.stat().st_size for f in Path(scratch, name).rglob("*.parquet")) for name in ("texts", "shards")}
    assert size["shards"] < size["texts"]


@pytest.mark.parametrize("words, ids", [
    ([], [-1, -1]), ([b"x"], [0, -1]), ([b"b", b"a\x00", b"a", "\u00fc".encode(), b"w" * 64, b"w" * 65, b"w" * 64 + b"v"],
                                        [-1, 6, 5, 6, -1, 0, 1, 2, 3, 4, 6, -1])])
def test_a_block_comes_back_as_it_was(words, ids):
    packed = P.pack_block(words, np.array(ids, np.int32))
    listed, places = P.unpack_block(*(pa.scalar(x, pa.binary()) for x in packed))
    listed.validate(full=True)
    assert places.dtype == np.int32 and sorted(listed.to_pylist()) == sorted(words)
    assert [listed[k].as_py() if k >= 0 else None for k in places.tolist()] == [words[k] if k >= 0 else None for k in ids]
    hashes = P.word_hashes(listed, np.uint64(9))
    assert len(set(hashes.tolist())) == len(words) and (P.word_hashes(listed.slice(1), np.uint64(9)) == hashes[1:]).all()
    keys = [b"en\n" + w for w in listed.to_pylist()]
    lengths, of_key = P._phrase_hashes(keys)
    assert (lengths == 1).all() and (of_key == P.word_hashes(listed, P._language_seed("en"))).all()


def test_shuffle_files_go_as_a_step_ends(spark, tmp_path):
    """One query's shuffle files do not lie beside the next one's; the setting is as before afterwards."""
    import time

    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: sum(f.getName().startswith("shuffle_") for f in _all_files(root))
    was, before = spark.conf.get(P.FREED, None), files()
    with P.shuffle_files_freed(spark):
        spark.range(10_000).selectExpr("id % 977 AS k").groupBy("k").count().write.parquet(str(tmp_path / "t"))
    until = time.monotonic() + 10
    while files() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert files() <= before and spark.conf.get(P.FREED, None) == was
    assert spark.read.parquet(str(tmp_path / "t")).count() == 977


def _all_files(disk):
    found = disk.getAllFiles().iterator()
    while found.hasNext():
        yield found.next()
