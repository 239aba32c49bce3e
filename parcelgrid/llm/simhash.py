"""SimHash near-duplicates by anchor-point covering.

Fingerprint: the 64 majority bits of XXH64 (seed 42) over the text's word
shingles.  Two fingerprints link when at most ``max_bits`` bits differ.

Candidate search.  The 64 bits are cut into ``max_bits // 2 + 1`` blocks (2 at least); a pair
within ``max_bits`` differs in at most one bit on some block (pigeonhole).  Each
block is covered by anchors: the words of a perfect Hamming code of length
``2**r - 1`` on its low bits, joined with every value of the bits left over.  The
covering radius is 1, so every block value has a home anchor within one bit, and
a value one bit further lies within radius plus threshold, 2, of that anchor.
Each distinct fingerprint is replicated to every anchor within 2 (for a 32-bit
block: 17 at most) and compared at the anchor with the fingerprints that have it
as home, by the full bit distance.  A code word per block value keeps anchors as
many as the data needs: 2**27 for each 32-bit block.

Copies collapse to one fingerprint before the search, and linked fingerprints
are merged by connected components, so groups of copies are never expanded.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.components import component_roots
from parcelgrid.llm.merge_automaton import in_slices
from parcelgrid.llm.shipping import ship_package
from parcelgrid.session import ensure_checkpoint_dir

BITS = 64
HASHES_AT_ONCE = 1 << 16
_hash = functools.partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned fingerprint of one whole text; 0 without words."""
    found = text.encode().lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, HASHES_AT_ONCE):
        part = found[at:at + HASHES_AT_ONCE + words - 1]
        shingles = zip(*(part[k:] for k in range(words))) if len(found) >= words else [part]
        hashes = np.fromiter(map(_hash, map(b" ".join, shingles)), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp): one row per input row; fp is the fingerprint as a signed long.  Null text: no words.
    ``carry`` columns are taken along."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in in_slices(batches):
            found = np.array([fingerprint(text, words) for text in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                                             ["id", "fp", *carry])

    taken = "".join(f", `{c}` {narrow.schema[c].dataType.simpleString()}" for c in carry)
    return narrow.mapInArrow(run, f"id {id_type}, fp long{taken}")


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    n = max(2, max_bits // 2 + 1)
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _code(width: int) -> tuple[int, list[int]]:
    """Check bits r of the longest Hamming code that fits, and the parity masks over bit places 1 .. 2**r - 1."""
    r = width.bit_length() if width + 1 == 1 << width.bit_length() else width.bit_length() - 1
    places = range(1, 1 << r)
    return r, [sum(1 << (p - 1) for p in places if p >> c & 1) for c in range(r)]


def _syndrome(value: Column, masks: list[int]) -> Column:
    """Place (from 1) of the bit that differs from the nearest code word, 0 for a code word."""
    parts = [F.shiftleft(F.bit_count(value.bitwiseAND(F.lit(m))) % 2, c) for c, m in enumerate(masks)]
    return functools.reduce(lambda x, y: x + y, parts)


def _near_masks(r: int, width: int) -> list[list[int]]:
    """By syndrome: the changes that lead to every anchor within two bits."""
    covered = (1 << r) - 1
    free = [1 << b for b in range(covered, width)]
    table = []
    for s in range(covered + 1):
        home = 1 << (s - 1) if s else 0
        pairs = [1 << (p - 1) | 1 << ((p ^ s) - 1) for p in range(1, covered + 1) if s and p < p ^ s]
        spare = 1 if s else 2  # bits that may differ beside the way to the home anchor
        changes = [home, *pairs, *(home | f for f in free)]
        if spare == 2:
            changes += [f | g for k, f in enumerate(free) for g in free[k + 1:]]
        table.append(changes)
    return table


def _block_value(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1))


def linked_pairs(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """(a, b), a < b, of distinct fingerprints (column fp) at most ``max_bits`` bits apart; each pair once a block at
    most: within a block either one of a pair finds the other at its home anchor."""
    homes, copies = [], []
    for k, (first, width) in enumerate(_blocks(max_bits)):
        r, masks = _code(width)
        rows = (", ".join(f"{m}L" for m in row) for row in _near_masks(r, width))
        table = F.expr("array(" + ", ".join(f"array({row})" for row in rows) + ")")
        value = distinct.select("fp", _block_value(F.col("fp"), first, width).alias("v"))
        value = value.select("fp", "v", _syndrome(F.col("v"), masks).cast("int").alias("s"))
        homes.append(value.select(
            F.when(F.col("s") > 0, F.col("v").bitwiseXOR(F.expr("shiftleft(1L, s - 1)"))).otherwise(F.col("v"))
            .alias("anchor"), F.lit(k).alias("block"), F.col("fp").alias("a")))
        copies.append(value.select(F.explode(F.get(table, F.col("s"))).alias("change"), "v", "fp")
                      .select(F.col("v").bitwiseXOR(F.col("change")).alias("anchor"), F.lit(k).alias("block"),
                              F.col("fp").alias("b")))
    home, near = (functools.reduce(DataFrame.unionByName, x) for x in (homes, copies))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return home.join(near, (home.anchor == near.anchor) & (home.block == near.block) & (F.col("a") < F.col("b"))
                     & close).select("a", "b")


def _rooted(found: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root): the smallest fingerprint of each fingerprint's component."""
    distinct = found.select("fp").distinct().checkpoint()
    roots = component_roots(linked_pairs(distinct, max_bits), "a", "b")
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                       max_bits: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    ``fp`` is a signed long; ``component_id`` is the smallest id that links reach,
    the row's own included.  Null and empty texts and texts without words have
    fingerprint 0 and link like any other; a text of fewer words than a shingle
    is one shingle.  A null id takes part but never names a component while a
    member has one (all null: null).  Repeated rows share a component; an empty
    table gives no rows; other columns are ignored whatever their names.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    found = fingerprints(docs, id_col, text_col, words).checkpoint()
    firsts = found.groupBy("fp").agg(F.min("id").alias("first"))
    rooted = firsts.join(_rooted(found, max_bits), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return found.join(named, "fp").select("id", "fp", "component_id").withColumnRenamed("id", id_col)


def _text_mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_one_each(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component, with all its columns: the row with the smallest id.

    The decision is by row, whatever ids repeat: a component's rows order by id (null
    last), then by a checksum of the text, and the first one stays.  Rows of one id
    with texts in two components are judged in each; rows without an id collapse with
    their copies like any other, and one stays only where its component has no id.
    Of rows that are equal in id and text one stays, an arbitrary one of their other columns.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    marked = docs.withColumn("__mark", _text_mark(text_col))
    found = fingerprints(marked, id_col, text_col, words, carry=("__mark",)).checkpoint()
    rows = found.groupBy("fp", "id", "__mark").agg(F.count("*").alias("copies"))
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "__mark", "copies")
    stay = (rows.join(_rooted(found, max_bits), "fp").groupBy("root").agg(F.min(first).alias("s"))
            .select(F.col("s.id").alias("__id"), F.col("s.__mark").alias("__kept_mark"), F.col("s.copies").alias("__copies"))
            .checkpoint())
    own = marked[id_col].eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__kept_mark"))
    kept = marked.join(stay.where("__copies = 1"), own, "left_semi").drop("__mark")
    repeated = stay.where("__copies > 1")
    if not repeated.isEmpty():  # only rows of such ids are grouped: whole texts are not shuffled again for the rest
        kept = kept.unionByName(marked.join(repeated, own, "left_semi").dropDuplicates([id_col, "__mark"]).drop("__mark"))
    return kept
