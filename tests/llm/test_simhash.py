import random

import numpy as np
import xxhash

from parcelgrid.llm import simhash as S
from parcelgrid.llm.components import component_roots


def plain_fingerprint(text, k=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, bits=3):
    label = {}
    for i, f in zip(ids, fps):
        label.setdefault(f, []).append(i)
    keys = list(label)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if (a ^ b).bit_count() <= bits:
                parent[root(a)] = root(b)
    least = {}
    for k in keys:
        known = [i for i in label[k] if i is not None]
        r = root(k)
        least[r] = min([*known, *([least[r]] if least.get(r) is not None else [])], default=None)
    return [least[root(f)] for f in fps]


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["Ab", "c", "É", " ", "\n", "\x1c", " ", "d ", "e f "]) for _ in range(rng.randint(0, 30)))
        assert S.fingerprint(text) == plain_fingerprint(text)
    long = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(3000))
    assert S.fingerprint(long) == plain_fingerprint(long)


def test_every_pair_within_the_bits_meets_at_an_anchor(spark):
    rng = random.Random(9)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for flips in range(1, 6):
            other = base
            for b in rng.sample(range(64), flips):
                other ^= 1 << b
            fps.append(other)
    for bits in (1, 3, 5):
        table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in set(fps)], "fp long")
        found = {frozenset((a & (1 << 64) - 1, b & (1 << 64) - 1)) for a, b in
                 S.linked_pairs(table, bits).collect()}
        own = sorted(set(fps))
        want = {frozenset((a, b)) for n, a in enumerate(own) for b in own[:n] if (a ^ b).bit_count() <= bits}
        assert found == want


def test_components_and_odd_rows(spark, docs_of):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=80))) for k in range(40)]
    rows += [(100 + k, rows[0][1] + f" tail{k}") for k in range(30)] + [(7, rows[7][1]), (None, rows[3][1])]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "only here without an id"), (203, "two words")]
    docs = docs_of(rows)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.fp & (1 << 64) - 1,
                  r.component_id if r.component_id is not None else -1) for r in S.simhash_components(docs).collect())
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = plain_components([i for i, _ in rows], fps)
    assert got == sorted((i if i is not None else -1, f, c if c is not None else -1)
                         for (i, _), f, c in zip(rows, fps, want))
    kept = S.keep_one_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in want if c is not None})
    assert ids.count(None) == 1  # the row without an id that is a copy of row 3 goes
    assert S.simhash_components(docs.limit(0)).count() == 0
    assert S.keep_one_each(docs.limit(0)).count() == 0


def test_rows_are_judged_one_by_one(spark, docs_of):
    """Repeated ids with other texts and null ids: every component keeps exactly one row, and no other text is lost."""
    rng = random.Random(12)
    words = [f"v{k}" for k in range(500)]
    a, b, c, d = (" ".join(rng.choices(words, k=90)) for _ in range(4))
    rows = [(1, a), (1, b), (None, c), (None, c), (3, c), (3, c), (None, d), (None, d), (5, b), (2, None), (9, ""),
            (None, " ")]
    kept = [(r.doc_id, r.text) for r in S.keep_one_each(docs_of(rows).repartition(3)).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (3, c), (None, d), (2, None)], key=str)
    many = [(k % 7, rng.choice([a, b, c, d, f"own text of {k // 3} " * 3])) for k in range(120)]
    kept = [(r.doc_id, r.text) for r in S.keep_one_each(docs_of(many).repartition(4)).collect()]
    label = dict(zip((t for _, t in many), plain_components(range(120), [plain_fingerprint(t) for _, t in many])))
    least = {}
    for i, t in many:
        least[label[t]] = min(i, least.get(label[t], i))
    assert sorted((label[t], i) for i, t in kept) == sorted(least.items())


def test_component_roots(spark):
    chain = [(k, k + 1) for k in range(70)] + [(500, 501), (501, 500), (9, 9), (900, 900), (None, 3)]
    got = dict(component_roots(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect())
    assert got == {**{k: 0 for k in range(71)}, 500: 500, 501: 500}
    assert component_roots(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
