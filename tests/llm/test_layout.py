"""Sharding, mixing, chats, search and archives."""

import base64
import gzip
import hashlib
import json
import os
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parcelgrid.llm import kmeans_tree, mixing, sharding, warc
from parcelgrid.llm.chat import format_chat_parts, format_chats, with_prefix_hashes
from parcelgrid.llm.kmeans_tree import Tree, nearest_neighbours

SF = "/root/testdata/sf0.01"


def test_shards_by_bytes(spark, docs_of, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.assign_shards(docs, 8, scratch + "/map").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    load, places = Counter(), defaultdict(list)
    for r in got:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert len(got) == len(texts) and len(load) == 8
    assert max(load.values()) - min(load.values()) < 0.005 * sum(load.values()) / 8
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    first, second = (dict(sharding.read_map(spark, scratch + "/map", v).collect()) for v in (0, 1))
    assert len(first) == len(second) == sharding.VIRTUAL_SLOTS and first != second
    assert all(second[r.virtual_slot] == r.shard for r in got)

    odd = docs_of([(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 100000)])
    found = sharding.assign_shards(odd, 3, scratch + "/odd").collect()
    assert sorted(r.size for r in found) == [1, 1, 1, 1, 200001]
    assert sharding.assign_shards(odd.limit(0), 3, scratch + "/none").count() == 0


def test_many_equal_rows_spread_over_shards(spark, docs_of, scratch):
    rows = [(k, f"text {k} " * 12) for k in range(2000)] + [(None, "the same text again and again " * 6)] * 1000
    got = sharding.assign_shards(docs_of(rows).repartition(5), 8, scratch + "/hot").collect()
    load, slots, places = Counter(), Counter(), defaultdict(list)
    for r in got:
        load[r.shard] += r.size
        slots[r.virtual_slot] += 1
        places[r.shard].append(r.slot)
    assert len(got) == 3000 and max(load.values()) - min(load.values()) <= 0.01 * sum(load.values()) / 8
    assert max(slots.values()) <= 4 * sharding.EQUAL_ROWS  # no window group holds the equal rows
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_stored_map_is_edited_not_made_anew(spark, docs_of, scratch):
    rng = random.Random(4)
    rows = [(k, "x" * rng.randint(1, 400)) for k in range(3000)]
    folder = scratch + "/map"
    first = {r.doc_id: r.shard for r in sharding.assign_shards(docs_of(rows[:2500]), 6, folder).collect()}
    again = {r.doc_id: r.shard for r in sharding.assign_shards(docs_of(rows[:2500]), 6, folder).collect()}
    assert again == first and sharding.last_version(spark, folder) == 2  # balanced already: nothing moves
    found = sharding.assign_shards(docs_of(rows), 6, folder).collect()
    maps = [dict(sharding.read_map(spark, folder, v).collect()) for v in (2, 3)]
    moved = sum(maps[0][s] != maps[1][s] for s in maps[0])
    assert 0 < moved < 0.1 * len(maps[0]) and sharding.last_version(spark, folder) == 3
    assert all(maps[1][r.virtual_slot] == r.shard for r in found)
    fewer = sharding.assign_shards(docs_of(rows), 4, folder).collect()
    assert {r.shard for r in fewer} == {0, 1, 2, 3}
    with pytest.raises(ValueError):
        sharding.assign_shards(docs_of(rows), 4, folder, n_slots=64)


def test_mix_deals_very_many_equal_rows(spark, docs_of):
    rows = [(k, f"t{k}", "ab"[k % 2]) for k in range(400)] + [(9, "same", "a")] * 300 + [(None, None, "b")] * 200
    docs = docs_of(rows).repartition(4)
    got = mixing.mix(docs, {"a": 2, "b": 1}, block_rows=4, period=40, bucket_rows=20).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    assert len({(r.source, r.block, r.row_in_block) for r in got}) == len(rows)
    counts = Counter(r.source for r in got)
    assert all({r.block for r in got if r.source == s} == set(range(-(-n // 4))) for s, n in counts.items())
    numbered = docs.selectExpr("CASE source WHEN 'a' THEN 0 ELSE 1 END AS source_no", "doc_id AS __id", "xxhash64(doc_id, text) AS __key")
    deals = mixing._dealt(numbered, 20).groupBy("source_no", "__key", "__deal").count().where("__deal > 0").collect()
    assert 25 <= len(deals) <= 30 and max(r["count"] for r in deals) < 50  # 300 and 200 equal rows in groups of about 20
    ordered = mixing.mixed_order(docs, block_rows=4, bucket_rows=20)
    assert ordered.columns == docs.columns and ordered.count() == len(rows)


def test_rebalance_moves_only_what_it_must():
    rng = random.Random(1)
    sizes = [rng.randint(50, 150) for _ in range(4096)]
    start = sharding.first_map(4096, 8)
    even = sharding.rebalance(start, sizes, 8)
    load = Counter()
    for s, shard in zip(sizes, even):
        load[shard] += s
    assert max(load.values()) - min(load.values()) <= 0.001 * sum(sizes) / 8
    assert sum(a != b for a, b in zip(start, even)) < 0.1 * 4096
    assert sharding.rebalance(even, sizes, 8) == even


def test_mix_keeps_every_source_within_a_block(spark, docs_of):
    rng = random.Random(6)
    rows = [(k, f"t{k}", rng.choices(["a", "b", "c", None], [60, 25, 10, 5])[0]) for k in range(900)]
    docs = docs_of(rows + [(5, "t5", "a"), (5, "t5", "a"), (None, None, "b")])
    for weights in (None, {"a": 0.5, "b": 0.2, "c": 0.2, None: 0.1}):
        got = mixing.mix(docs, weights, block_rows=4, period=40).collect()
        assert len(got) == 903 and Counter(r.doc_id for r in got)[5] == 3
        assert all(r.release <= r.place < r.deadline for r in got)
        blocks = {r.place: (r.source, r.block, r.phase) for r in got}
        assert sorted(blocks) == list(range(len(blocks)))
        assert len({(r.source, r.block, r.row_in_block) for r in got}) == 903
        counts = Counter(r.source for r in got)
        order = sorted(counts, key=lambda s: (s is None, str(s)))
        sizes = [-(-counts[s] // 4) for s in order]
        given = [weights[s] for s in order] if weights else [n ** 0.5 for n in sizes]
        for phase in mixing.phases(sizes, given, 40):
            served = Counter()
            for t in range(phase["length"]):
                served[blocks[phase["start"] + t][0]] += 1
                for k, source in enumerate(phase["active"]):
                    assert abs(served[order[source]] - phase["shares"][k] / phase["total"] * (t + 1)) < 1
    assert mixing.mix(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, max_sources=2)


@pytest.mark.parametrize("sizes, weights", [
    ([10_000] + [50] * 100, [0.9] + [0.001] * 100), ([8000, 8000, 8000, 8000], [0.5, 0.2, 0.2, 0.1]),
    ([40_000] + [20] * 1999, [1000] + [1 + k % 7 for k in range(1999)])])
def test_mix_holds_the_given_weights(sizes, weights):
    whole = [Fraction(str(w)) for w in weights]
    target = [w / sum(whole) for w in whole]
    first = next(iter(mixing.walk_phases(sizes, weights)))
    assert len(first["active"]) == len(sizes)
    assert all(abs(n - w * first["length"]) < 1 for n, w in zip(first["served"], target))
    served = [0] * len(sizes)
    for _, k, j, release, due, time in mixing.places_of(0, 0, first["active"], first["shares"], first["first"], 0,
                                                        first["length"]):
        assert j == served[k] and release <= time < due
        served[k] += 1  # every block within its window: less than one block off at every time
        assert abs(served[k] - target[k] * (time + 1)) < 1 and abs(j - target[k] * time) < 1
    assert served == first["served"]


def test_state_at_any_time_is_that_of_the_walk():
    rng = random.Random(3)
    for _ in range(20):
        shares = [rng.choice([1, 2, 3, 7, 50, 1000]) for _ in range(rng.randint(1, 12))]
        served = [0] * len(shares)
        for (k, *_), time in zip(mixing.schedule(shares, [0] * len(shares), 0), range(400)):
            assert mixing.served_by(time, shares) == served
            served[k] += 1


def test_long_plan_made_in_spark_equals_the_short_one(docs_of):
    docs = docs_of([(k, f"t{k}", "abcd"[(k % 11 > 5) + (k % 7 > 4) + (k % 5 > 3)]) for k in range(1500)])
    for weights in (None, {"a": 0.7, "b": 0.15, "c": 0.1, "d": 0.05}):
        here = mixing.mix(docs, weights, block_rows=2, period=50).collect()
        there = mixing.mix(docs, weights, block_rows=2, period=50, plan_blocks=10).collect()
        assert sorted(map(tuple, here)) == sorted(map(tuple, there)) and len(there) == 1500


def test_mixed_order_keeps_rows_and_order(docs_of, scratch, spark):
    docs = docs_of([(k, f"t{k}", "ab"[k % 5 == 0]) for k in range(400)])
    mixed = mixing.mixed_order(docs, block_rows=8, period=16)
    assert mixed.columns == docs.columns
    mixed.write.parquet(scratch + "/mix")
    place = {r.doc_id: (r.place, r.row_in_block) for r in mixing.mix(docs, block_rows=8, period=16).collect()}
    files = sorted(f for f in os.listdir(scratch + "/mix") if f.endswith(".parquet"))
    read = [place[r.doc_id] for f in files for r in spark.read.parquet(f"{scratch}/mix/{f}").collect()]
    assert read == sorted(read) and len(read) == 400


def test_chats_against_plain_prefixes(spark):
    rng = random.Random(8)
    logs = {}
    for conv in range(60):
        logs[conv] = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(1, 4))]
    rows = [(c, t, r, x, "extra") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [(100, 0, None, None, "e"), (None, 0, "user", "z", "e"), (None, 1, "user", "y", "e")]
    logs |= {100: [("", "")], None: [("user", "z"), ("user", "y")]}
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string"))
    whole = defaultdict(list)
    for c, turns in logs.items():
        whole[tuple(turns)].append(c)
    longer = {tuple(t[:n]) for t in logs.values() for n in range(1, len(t))}
    want = {(min((c for c in cs if c is not None), default=None), len(t), len(cs),
             "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t)) for t, cs in whole.items() if t not in longer}
    assert {tuple(r) for r in got.collect()} == want
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversations_are_cut_to_buckets(spark):
    rng = random.Random(4)
    rows = [(None, rng.randint(0, 3), "user", rng.choice(["x", "y", None, "z" * 300])) for _ in range(400)]
    rows += [(7, t, rng.choice(["user", "assistant"]), f"t{t % 5}") for t in range(300)]
    rows += [(8, t, r, x) for _, t, r, x in rows[400:650]]  # a prefix of 7
    rows += [(k, t, "user", "hi") for k in (20, 21) for t in range(3)] + [(9, 0, "user", "x")] * 90
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, format_chats(turns).collect()), key=str)
    assert sorted(map(tuple, format_chats(turns, bucket_turns=16).collect()), key=str) == whole
    assert {r[0] for r in whole} == {None, 7, 9, 20}
    cut = with_prefix_hashes(turns, 16).groupBy("conv_id", "piece").count().collect()
    assert max(r["count"] for r in cut) <= 16  # no group of a long conversation grows
    assert format_chat_parts(turns).count() == len(whole)
    parts = defaultdict(list)
    for r in format_chat_parts(turns, bucket_turns=16, part_chars=200).collect():
        assert len(r.rendered) <= 200 + 340
        parts[r.conv_id, r.n_turns, r.n_copies].append((r.first_turn, r.rendered))
    assert sorted(((*k, "".join(x for _, x in sorted(v))) for k, v in parts.items()), key=str) == whole


def test_nearest_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    ids, vecs = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(list)
    for r in nearest_neighbours(table, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append(r)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    hit = total = 0
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        scores = vecs @ vecs[ids == q][0]
        truth = [i for i in ids[np.lexsort((ids, -scores))].tolist() if i != q][:20]
        hit += len(set(truth) & {r.vec_id for r in found})
        total += 20
        assert all(abs(r.score - scores[ids == r.vec_id][0]) < 1e-12 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hit / total >= 0.9


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, -0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (80, []), (9, [-1.0, -0.0]),
            (40, [1.0, 2.0, 3.0]), (8, [0.0, 1.0, 0.0]), (60, [5.0])]  # of other dimensions
    table = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, v string, leaf double")
    got = [tuple(r) for r in nearest_neighbours(table, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 2, 0.5),
                   (40, 1, 8, 2.0)]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "hot", "two dimensions"])
def test_nearest_reaches_most_neighbours_of_nearly_every_query(spark, kind):
    rng = np.random.default_rng(3)
    n = 3000
    vecs = rng.normal(size=(60, 12))[rng.integers(0, 60, n)] * 3 + rng.normal(size=(n, 12)) * 0.3
    if kind == "hot":
        vecs[::3] = vecs[1]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    if kind == "two dimensions":
        rows = [(i, v[:7] if i % 4 == 0 else v) for i, v in rows]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    found, about = kmeans_tree.search(table, F.col("vec_id") % 20 == 0, 20, 0.95)
    got = defaultdict(list)
    for r in found.collect():
        got[r.query_id].append((-r.score, r.vec_id))
    recalls = []
    for q, v in rows[::20]:
        truth = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        assert len(got[q]) == 20  # never fewer than there are candidates
        recalls.append(sum(-s >= -truth[19][0] - 1e-9 for s, _ in got[q]) / 20)
    assert np.mean(recalls) >= 0.93 and np.mean(np.array(recalls) < 0.5) <= 0.05
    assert about["met"] < 0.5


def test_search_shuffles_each_vector_once_however_many_ask(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2500, 6)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = {}
    meet = kmeans_tree._meet
    for every in (50, 5):
        counted = []

        def spy(asked, filed, k):
            counted.append((asked.count(), filed.count()))
            return meet(asked, filed, k)
        kmeans_tree._meet = spy
        try:
            kmeans_tree.nearest_neighbours(table, F.col("vec_id") % every == 0, k=5).count()
        finally:
            kmeans_tree._meet = meet
        assert all(filed == 2500 for _, filed in counted) and len(counted) == 2
        sent[every] = sum(asked for asked, _ in counted)
    assert sent[5] < 15 * sent[50]  # rows sent grow with the queries, and no vector is copied for them


def test_search_holds_few_queries_and_products_at_a_time(monkeypatch):
    """However many packs the queries of a batch visit, and however many vectors and queries meet in a pack."""
    rng = np.random.default_rng(8)
    vecs = list(rng.normal(size=(1500, 4)))
    asked = pd.DataFrame({"query_id": range(1500), "least": -np.inf, "v": vecs})
    monkeypatch.setattr(kmeans_tree, "ASKED_BYTES", 5000)
    frames = list(kmeans_tree._by_pack(iter([asked]), lambda v, floor: range(30), {f"4:{n}": [n // 3, 99] for n in range(30)}))
    assert max(8 * (4 * len(f) + f["seen"].map(len).sum()) for f in frames) <= 5000 + 8 * 34
    rows = pd.concat(frames)
    assert len(rows) == 1500 * 11 and all(rows["pack"].value_counts() == 1500)
    assert rows[rows["pack"] == 4]["seen"].map(tuple).unique().tolist() == [(12, 13, 14)]
    held = pd.DataFrame({"pack": 1, "side": 0, "query_id": None, "least": None, "seen": [[n % 2] for n in range(6000)],
                         "ids": [[n + 5000] for n in range(6000)], "v": list(rng.normal(size=(6000, 4)))})
    meeting = asked.assign(pack=1, side=1, seen=[[0, 1]] * 1500, ids=None)
    shapes, compared = [], kmeans_tree._compared

    def spy(*args):
        shapes.append(compared(*args).shape)
        return compared(*args)
    monkeypatch.setattr(kmeans_tree, "_compared", spy)
    best = pd.concat(kmeans_tree._answers(iter([held[:4000], pd.concat([held[4000:], meeting[:100]]), meeting[100:]]), 1))
    assert sum(n for n, _ in shapes) == 1500 and max(n * m for n, m in shapes) <= 1 << 22
    scores = np.array(vecs) @ np.array(held["v"].tolist()).T
    assert best.sort_values("query_id")["vec_id"].tolist() == (scores.argmax(axis=1) + 5000).tolist()


def test_no_python_in_native_layout_plans(spark, docs_of, scratch):
    turns = spark.createDataFrame([(k % 3, k, "user", f"t{k}") for k in range(60)], "conv_id long, turn long, role string, text string")
    for frame in (sharding.assign_shards(docs_of([(k, "a") for k in range(40)]), 3, scratch + "/m"), format_chats(turns),
                  format_chats(turns, bucket_turns=5), format_chat_parts(turns, bucket_turns=5)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


def test_long_chats_are_numbered_whatever_their_turns_share(spark):
    """Turns that differ only far into the text, very many equal turns, and no id at all."""
    head = "h" * 400
    rows = [(None, 1, "u", f"{head}{k}") for k in range(120)] + [(None, 1, "u", "same")] * 150 + [(7, k, "u", "x") for k in range(3)]
    rows += [(8, 5, "u", f"{head}{k % 50}") for k in range(90)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = sorted(map(tuple, format_chats(turns).collect()), key=str)
    hashed = with_prefix_hashes(turns, bucket_turns=16, range_turns=40)
    places = defaultdict(list)
    for r in hashed.collect():
        places[r.conv_id].append(r.pos)
    assert {c: sorted(p) for c, p in places.items()} == {None: list(range(1, 271)), 7: [1, 2, 3], 8: list(range(1, 91))}
    assert sorted(map(tuple, format_chats(turns, bucket_turns=16).collect()), key=str) == whole


def test_packs_hold_neighbouring_leaves():
    held = {"3:0": 4, "3:1": 5, "3:2": 2, "3:10": 30, "12:0": 1, "3:11": 9}
    packs = kmeans_tree._packs(held, 10)
    assert packs == {"3:0": [0], "3:1": [0], "3:2": [1], "3:10": [2, 3, 4], "3:11": [5], "12:0": [6]}


def test_tree_walk_yields_every_leaf_once():
    rng = np.random.default_rng(0)
    tree = Tree(rng.normal(size=(2000, 8)), branching=4, leaves=32)
    q = rng.normal(size=8)
    walk = [leaf for leaf, _ in tree.walk(q)]
    assert sorted(walk) == list(range(len(tree.leaf_no))) and len(walk) > 8
    assert tree.leaf_of(rng.normal(size=(50, 8))).max() < len(walk)
    sizes = [10] * len(walk)
    assert tree.pilot(q, sizes, 35) == tree.visits(q, 0, float("inf"), sizes, 35) == walk[:4]
    assert tree.visits(q, 9, float("-inf"), sizes, 35) == walk[:9] and tree.visits(q, 999, float("-inf"), sizes, 0) == walk
    assert tree.visits(q, 999, 1e9, sizes, 35) == walk[:4]  # nothing can reach such a floor


def test_archives_round_trip(spark, scratch):
    texts = {1: "same", 2: "same", 3: None, 4: "", 5: "ü" * 100000, 6: "a\r\n\r\nContent-Length: 3\r\n\r\nb", 7: "same"}
    rows = [(k, f"http://x/{k} y\n", t, "e") for k, t in texts.items()] + [(7, None, "same", "e"), (None, "u", "same", "e"),
                                                                        (None, "u", "lone", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    files = warc.write_monolithic(warc.assign_records(pages), scratch, file_bytes=300)
    index = warc.normalise(files, scratch)
    got = warc.read_records(index, scratch, with_payload=True).collect()
    assert len(got) == len(rows)
    largest = {}
    for k, _, t, _ in rows:
        largest[t or ""] = max(largest.get(t or "", -1), -1 if k is None else k)
    text_of = {base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(): t for t in largest}
    for r in got:
        text = text_of[r.payload_digest]
        assert r.payload_bytes == len(text.encode())
        top = largest[text] if largest[text] >= 0 else None
        if r.page_id == top:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, text.encode())
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("revisit", top, b"")
    members = [f for f in os.listdir(scratch) if f.startswith("members-") and f.endswith(".gz")]
    for name in members:  # standard readers see one stream of members; the sidecar finds each
        data = open(f"{scratch}/{name}", "rb").read()
        lines = [json.loads(x) for x in open(f"{scratch}/{name}.idx")]
        parts = [gzip.decompress(data[x["offset"]:x["offset"] + x["length"]]) for x in lines]
        assert b"".join(parts) == gzip.decompress(data) and all(p.startswith(b"WARC/1.1\r\n") for p in parts)
    assert warc.archive_and_read(pages.limit(0), scratch + "/none").count() == 0
