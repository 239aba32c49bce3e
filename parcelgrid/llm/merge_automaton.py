"""Byte-pair encoding as a deterministic automaton over tokens, and decoding by its arc labels.

Method: the automaton begins with one state that loops on every base symbol and
accepts every symbol string.  Each merge ``(a, b) -> ab``, in rank order, is one
gadget on it: the state entered by ``a`` loses its arc ``b`` (the pair may not
stand side by side any more), and every state that had the path ``a, b`` gets an
arc ``ab`` into the state that ``b`` entered *as it stood then*.  After the last
gadget the automaton accepts exactly the token strings that merging yields, one
for each symbol string.

A state is kept as what it lost: the arcs subtracted at the token that enters it,
and a link to the state (of the merge's right part, at that rank) it was copied
from.  So a gadget costs constant space and the whole file compiles in well under
a second.

Encoding reads a word's symbols from left to right through a symbol trie of the
live tokens and the arc table.  The table is not laid out in full (states times
tokens): whether a state has an arc follows from what it and its parts lost, is
looked up when a text first asks for it, and is kept.  By the uniqueness above one token ends the
prefix at each position, so each position has a single live state and is entered
once; the search for the one accepted path tries longer arcs first.

``encode_decode`` reads whole texts (null: empty) and returns one row per input
row: the id column, ``n_tokens`` (long), ``ids`` (binary: ids as little-endian
unsigned 32-bit integers) and ``decoded`` (string).  Special strings of the
tokenizer file inside a text become their ids, as the library does by default.
Empty and null texts give 0 tokens and an empty decoded text; an empty table
gives no rows; repeated rows give repeated results; other columns of the input
are ignored whatever their names; a null id stays null.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelgrid.llm.shipping import ship_package
from parcelgrid.llm.wordsplit import WordCache, WordSplitter, byte_symbols

NEVER = 1 << 62
START = -1
ROWS_AT_ONCE = 256


class MergeAutomaton:
    """States are token ids (the token that enters them); ``START`` is the first state."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.lost: dict[int, dict[int, int]] = {}
        self.suffix = suffix
        symbols = byte_symbols()
        live = {vocab[s + e] for s in symbols for e in ("", suffix) if s + e in vocab}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b], live)
        self._arcs: dict[int, bool] = {}
        self._trie = self._symbol_trie(vocab, live)

    def _gadget(self, rank: int, a: int, b: int, merged: int, live: set[int]) -> None:
        if a not in live or b not in live:
            raise ValueError(f"merge {rank} uses a token that no earlier merge makes")
        if not self._has_arc(a, b):
            return  # the path a, b is gone already: the gadget adds and removes nothing
        if merged in live:
            raise ValueError(f"merge {rank} makes a token that exists already")
        self.lost.setdefault(a, {})[b] = rank
        self.left[merged], self.right[merged], self.born[merged] = a, b, rank
        live.add(merged)

    def _lost_at(self, state: int, token: int) -> int:
        """Rank of the gadget by which ``state`` lost its own arc ``token``."""
        limit = NEVER
        while state != START:
            rank = self.lost.get(state, {}).get(token, NEVER)
            if rank < limit:
                return rank
            limit = self.born.get(state, START)  # from here on: the state copied at that rank
            state = self.right.get(state, START)
        return NEVER

    def _has_arc(self, state: int, token: int) -> bool:
        """An arc for a merged token exists where its left part's arc still stood when it was added."""
        until = NEVER
        while token != START:
            rank = self._lost_at(state, token)
            if rank != NEVER and rank <= until:
                return False
            until = self.born.get(token, START)
            token = self.left.get(token, START)
        return True

    def has_arc(self, state: int, token: int) -> bool:
        key = (state << 32) + token
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) > 300_000:
                self._arcs.clear()
            found = self._arcs[key] = state == START or self._has_arc(state, token)
        return found

    def _symbol_trie(self, vocab: dict[str, int], live: set[int]) -> dict:
        """Node: {symbol: (next node, live token that ends here or START)}.

        Also fills ``size`` (symbols of a token) and ``shorter`` (the longest live
        token that is a proper prefix of a token, or START).
        """
        root: dict[int, list] = {}
        numbers = {s: k for k, s in enumerate(byte_symbols())}
        self.size, self.shorter = {}, {START: START}
        for text, token in sorted((t for t in vocab.items() if t[1] in live), key=lambda t: len(t[0])):
            ends = text.endswith(self.suffix) and text != self.suffix
            symbols = [numbers[c] for c in (text[: -len(self.suffix)] if ends else text)]
            symbols[-1] += len(numbers) if ends else 0
            node, before, entry = root, START, None
            for symbol in symbols:
                if entry is not None and entry[1] != START:
                    before = entry[1]
                entry = node.setdefault(symbol, [{}, START])
                node = entry[0]
            entry[1] = token
            self.size[token], self.shorter[token] = len(symbols), before
        self.longest = max(self.size.values(), default=0)
        return root

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one word, given as its bytes: the one path that the automaton accepts.

        Longer arcs are tried first.  A position has one live state, so a position
        from which the word's end was not reached is never entered again.
        """
        n, root, size, shorter, has_arc, arcs = len(word), self._trie, self.size, self.shorter, self.has_arc, self._arcs
        longest = self.longest
        if not n:
            return []
        symbols = list(word)
        symbols[-1] += 256
        path, at, state, closed = [], 0, START, set()
        token, node = START, root
        while True:
            for symbol in symbols[at:at + longest]:  # no token is longer: a word costs its own length
                entry = node.get(symbol)
                if entry is None:
                    break
                node, found = entry
                if found >= 0:
                    token = found
            while True:
                while token >= 0:
                    if at + size[token] not in closed:
                        allowed = arcs.get((state << 32) + token)
                        if allowed or allowed is None and has_arc(state, token):
                            break
                    token = shorter[token]
                if token >= 0:
                    break
                closed.add(at)
                last = path.pop()
                at -= size[last]
                state, token = path[-1] if path else START, shorter[last]
            path.append(token)
            at += size[token]
            if at == n:
                return path
            state, token, node = token, START, root


class Codec:
    """Whole texts to ids and back, for one tokenizer file given as its JSON text."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        self.splitter = WordSplitter(spec)
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.splitter.special.items()}
        self._label_list = [self.labels.get(i) for i in range(max(self.labels) + 1)]
        self._words = WordCache(self._encode_word)

    def _encode_word(self, word: str) -> bytes:
        ids = self.automaton.encode(word.encode())
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        parts = []
        for kind, piece in self.splitter.pieces(text):
            if kind == "special":
                parts.append(int(piece).to_bytes(4, "little"))
            else:
                parts.extend(map(self._words.__getitem__, piece))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Labels of the ids' arcs, joined by a space; unknown ids have none."""
        listed = np.frombuffer(ids, "<u4").tolist()
        try:
            return " ".join(map(self._label_list.__getitem__, listed))
        except (IndexError, TypeError):  # past the labels, or between them
            return " ".join(self.labels[i] for i in listed if i in self.labels)


_CODECS: dict[str, Codec] = {}


def codec_for(spec: bytes) -> Codec:
    """One compiled codec per Python worker and tokenizer file."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(spec.decode())
    return _CODECS[key]


def read_spec(path: str) -> bytes:
    """The tokenizer file, read on the driver (a fixed file of a few MB, sent to the executors once)."""
    with open(path, "rb") as f:
        return f.read()


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, so that results of long texts stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """Ids of every text and the text decoded from them (see the module's docstring); ``carry`` columns are taken along."""
    ship_package(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                         *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)])
    id_type = narrow.schema["id"].dataType.simpleString()
    taken = "".join(f", __c{k} {narrow.schema[f'__c{k}'].dataType.simpleString()}" for k in range(len(carry)))

    def run(batches):
        codec = codec_for(spec.value)
        for batch in in_slices(batches):
            ids = [codec.encode(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                 pa.array([codec.decode(x) for x in ids], pa.string()), *batch.columns[2:]],
                ["id", "n_tokens", "ids", "decoded", *batch.schema.names[2:]])

    return (narrow.mapInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string{taken}")
            .withColumnsRenamed({"id": id_col} | {f"__c{k}": c for k, c in enumerate(carry)}))


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of stored ids (binary as ``encode_decode`` makes them; null: empty)."""
    ship_package(encoded.sparkSession)
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    narrow = encoded.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches):
        codec = codec_for(spec.value)
        for batch in in_slices(batches):
            texts = [codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

    return narrow.mapInArrow(run, f"id {id_type}, decoded string").withColumnRenamed("id", id_col)
