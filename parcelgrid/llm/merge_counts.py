"""Token counts by byte-pair merging on a heap and a linked list.

Each word is a doubly linked list of symbols.  Adjacent pairs that the merge
table ranks wait in a heap by (rank, position); the lowest one is popped and
merged, its new neighbours are pushed, and stale entries are skipped.  The count
is the initial number of symbols minus the number of merges; no identifiers are
emitted.

``count_tokens`` reads whole texts (null: empty) and returns one row per input
row: the id column, ``n_bytes`` (long, UTF-8), ``n_tokens`` (long) and
``over_limit`` (boolean).  A special string inside a text counts as one token, as
the library's default handling has it.  Empty and null texts count 0; an empty
table gives no rows; repeated rows give repeated results; other columns are
ignored whatever their names; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.merge_automaton import in_slices, read_spec
from parcelgrid.llm.shipping import ship_package
from parcelgrid.llm.wordsplit import WordCache, WordSplitter, byte_symbols


class MergeCounter:
    """Symbols are numbered: byte symbols first, then word-end byte symbols, then the result of each merge by its rank."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        self.splitter = WordSplitter(spec)
        symbols = byte_symbols()
        numbers = {s: k for k, s in enumerate(symbols)}
        numbers |= {s + model["end_of_word_suffix"]: len(symbols) + k for k, s in enumerate(symbols)}
        self._ends = len(symbols)
        self._merged = len(numbers)
        self._ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._ranks.setdefault(numbers[a] << 32 | numbers[b], rank)
            numbers[a + b] = self._merged + rank
        self._words = WordCache(self._count_word)

    def _count_word(self, word: str) -> int:
        return self.count(word.encode())

    def count(self, word: bytes) -> int:
        """Tokens of one word, given as its bytes."""
        n, rank_of, merged = len(word), self._ranks.get, self._merged
        if n < 2:
            return n
        held = list(word)
        held[-1] += self._ends
        # a heap entry is rank * n + position, so ties of rank go to the leftmost pair
        heap = [rank * n + k for k in range(n - 1) if (rank := rank_of(held[k] << 32 | held[k + 1])) is not None]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, at = divmod(heappop(heap), n)
            then = after[at]
            if then >= n or held[at] < 0 or rank_of(held[at] << 32 | held[then]) != rank:
                continue  # one of the two was merged meanwhile
            held[at], held[then] = merged + rank, -1
            merges += 1
            after[at] = far = after[then]
            if far < n:
                before[far] = at
                if (rank := rank_of(held[at] << 32 | held[far])) is not None:
                    heappush(heap, rank * n + at)
            near = before[at]
            if near >= 0 and (rank := rank_of(held[near] << 32 | held[at])) is not None:
                heappush(heap, rank * n + near)
        return n - merges

    def count_text(self, text: str) -> int:
        total = 0
        for kind, piece in self.splitter.pieces(text):
            total += 1 if kind == "special" else sum(map(self._words.__getitem__, piece))
        return total


_COUNTERS: dict[str, MergeCounter] = {}


def counter_for(spec: bytes) -> MergeCounter:
    """One counter per Python worker and tokenizer file."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = MergeCounter(spec.decode())
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every text (see the module's docstring)."""
    ship_package(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        counter = counter_for(spec.value)
        for batch in in_slices(batches):
            texts = batch.column(1)
            counts = [counter.count_text(text) for text in texts.to_pylist()]
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())],
                                             ["id", "n_bytes", "n_tokens"])

    counted = narrow.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)
