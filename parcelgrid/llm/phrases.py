"""Phrase collocation mining by dynamic itemset counting.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and
pieces into words at spaces and tabs.  Everything is counted per language.

1. ``write_shards`` encodes the corpus once into ``shards`` shards of blocks: a
   block is the words of some documents of one language as numbers into its own
   word list, with breaks between pieces.  Word hashes are not written: a scan makes
   them again from the list.
2. ``count_phrases`` scans the shards in a cycle, one a step, and counts phrases
   of all lengths side by side.  Words are active from the first step.  A longer
   phrase becomes active as soon as both its subphrases (without its last and
   without its first word) have reached the threshold in the shards read so far,
   and stays so for one full cycle.  A phrase at the threshold has at least its
   ``shards``-th part in some shard: an active phrase opens with the first shard that
   holds so many of it, and is counted for one full cycle from there, after which its
   count is exact.  What opens nowhere is never kept from step to step.  The run ends
   when nothing is active or open, after ``5 * (2 * shards - 1)`` steps at most.
3. ``collocations`` scores the phrases that reached the threshold.

A phrase and its language are one binary key in the shuffles, and an open phrase
carries one number beside its count, so that a row there is small.

What a scan may skip is told by a filter of fixed size (``FILTER_CELLS`` bytes for
each of nine tables), the only thing that is broadcast: a cell holds the last step at
which a phrase of that hash reached the threshold, or opened.  The filter never hides
an active or open phrase, and counts are kept by the whole phrase in tables.  A phrase
that it lets pass again later, by mistake, may get a second count that is no larger;
the larger one is taken.  Length ``n`` is scanned in the first ``n * (2 * shards - 1)``
steps only, in which every phrase of that length has been active and open.

Open phrases are written as a table after every step (two folders, in turn), so that
a lost executor repeats one step at most.  Counts of a block are combined in the task that reads
it, so a word or phrase in every third place is one row a task in the shuffle.

A null text counts as empty, a null language as ``und``.  Texts without words
give nothing; repeated rows count each; an empty table gives no rows; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid.llm.merge_automaton import in_slices
from parcelgrid.llm.shipping import ship_package
from parcelgrid.session import ensure_checkpoint_dir

LONGEST = 5
SHARDS = 2
BLOCK_WORDS = 1 << 20
SCAN_WORDS = 4 << 20  # of one task
FILTER_CELLS = 1 << 22  # a power of two
SEGMENT_CELLS = 1 << 15
ROWS_OUT = 1 << 15
BREAK = b"\xff"  # in no UTF-8 text
KEY_END = b"\n"  # between language and phrase; in no phrase
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_SPLIT = bytes.maketrans(PIECE_ENDS, BREAK * len(PIECE_ENDS))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def words_and_breaks(text: bytes) -> list[bytes]:
    """The words of a text in order, with a break wherever a piece ends."""
    text = text.lower().translate(_SPLIT).replace(b"\t", b" ").replace(BREAK, b" \xff ")
    return [w for w in text.split(b" ") if w]


WORD_START = 64  # bytes of a word that are hashed side by side with other words'; longer ones are rare
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _language_seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def word_hashes(words: pa.Array, seeds: np.ndarray | np.uint64) -> np.ndarray:
    """64-bit hashes of words, none of them empty; ``seeds``: one for all, or one a word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    text = np.append(np.frombuffer(words.buffers()[2], np.uint8), np.zeros(8, np.uint8))
    eight = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))  # the eight bytes from each place on
    found = np.diff(ends).astype(np.uint64) * _SECOND ^ seeds
    for low in range(0, len(words), ROWS_OUT):
        own, begin = found[low:low + ROWS_OUT], ends[low:low + ROWS_OUT + 1]
        begin, size = begin[:-1], np.diff(begin)
        for at in range(0, min(int(size.max()), WORD_START), 8):
            on = np.flatnonzero(size > at)
            mixed = own[on] ^ (eight[begin[on] + at] & _FIRST_BYTES[np.minimum(size[on] - at, 8)])
            mixed *= _SPREAD
            own[on] = mixed ^ (mixed >> np.uint64(32))
        for k in np.flatnonzero(size > WORD_START):
            own[k] ^= np.uint64(xxhash.xxh64_intdigest(text[begin[k]:begin[k] + size[k]]))
    found *= _SECOND
    return found ^ (found >> np.uint64(29))


BLOCKS = "lang string, n long, words binary, ids binary"


def pack_block(words: list[bytes], ids: np.ndarray) -> tuple[bytes, bytes]:
    """A block as written: its words, often used ones first, between spaces, and its texts as places in them from 1
    (0: a piece ends), all lowest bytes before all next ones, so that both compress well.  ``ids``: -1 where a piece ends."""
    order = np.argsort(-np.bincount(ids[ids >= 0], minlength=len(words)), kind="stable")
    place = np.zeros(len(words) + 1, "<u4")
    place[order + 1] = np.arange(1, len(words) + 1)
    return b" ".join([words[k] for k in order.tolist()]), place[ids + 1].view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_block(words: pa.BinaryScalar, ids: pa.BinaryScalar) -> tuple[pa.Array, np.ndarray]:
    """The words and the ids, -1 where a piece ends, of a written block."""
    text = np.frombuffer(words.as_buffer(), np.uint8)
    between = np.flatnonzero(text == ord(" "))
    ends = np.concatenate([[0], between - np.arange(len(between)), [len(text) - len(between)][:len(text)]]).astype(np.int32)
    listed = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text[text != ord(" ")])])
    places = np.frombuffer(ids.as_buffer(), np.uint8).reshape(4, -1)
    return listed, np.ascontiguousarray(places.T).view("<i4").ravel() - np.int32(1)


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang",
                 block_words: int = BLOCK_WORDS) -> None:
    """Blocks under ``folder``, by shard: the language, its number ``n`` of word occurrences, and ``words`` and ``ids``
    as ``pack_block`` gives them."""
    narrow = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                         F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
                         F.spark_partition_id().alias("part"))

    def encode(batches):
        held: dict[str, tuple[dict, list]] = {}
        n, part, flushed = 0, 0, 0

        def blocks():
            shard = (part + flushed) % shards
            listed = [list(numbers)[1:] for numbers, _ in held.values()]  # number 0 is the break
            texts = [np.concatenate(ids) for _, ids in held.values()]
            packed = [pack_block(words, ids) for words, ids in zip(listed, texts)]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(held), pa.int32()), pa.array(list(held), pa.string()),
                 pa.array([int((ids >= 0).sum()) for ids in texts], pa.int64()),
                 pa.array([words for words, _ in packed], pa.binary()), pa.array([ids for _, ids in packed], pa.binary())],
                ["shard", "lang", "n", "words", "ids"])

        for batch in in_slices(batches):
            for lang, text, part in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007
                found = words_and_breaks(text)
                if lang not in held:
                    numbers: defaultdict = defaultdict()
                    numbers.default_factory = numbers.__len__
                    numbers[BREAK]  # number 0
                    held[lang] = numbers, []
                numbers, ids = held[lang]
                ids += [np.array(list(map(numbers.__getitem__, found)), np.int32) - 1, np.array([-1], np.int32)]
                n += len(found) + 1
                if n >= block_words:
                    yield blocks()
                    held, n, flushed = {}, 0, flushed + 1
        if held:
            yield blocks()
        held = {}
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it keeps

    coded = narrow.mapInArrow(encode, f"shard int, {BLOCKS}")
    coded.write.partitionBy("shard").option("compression", "zstd").parquet(folder)


def filter_places(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of each hash."""
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return (hashes * _SPREAD) >> shift, (hashes * _SECOND) >> shift


class PhraseFilter:
    """For each length: the last step (from 1; 0: none) at which a phrase of a hash reached the threshold, and opened.

    Cells only grow, and a hash is present when both its cells are set; its step is
    the larger one.  So from the step at which a phrase first passes, it goes on
    passing for a full cycle, whether it passed rightly or by mistake.
    """

    def __init__(self, cells: int = FILTER_CELLS):
        self.reached = np.zeros((LONGEST - 1, cells), np.uint8)
        self.opened = np.zeros((LONGEST, cells), np.uint8)
        self.last_reached, self.last_opened = [0] * (LONGEST + 1), [0] * (LONGEST + 1)  # of any phrase, by length

    def active(self, length: int, step: int, shards: int) -> bool:
        """Whether a phrase of this length may be active in ``step`` (from 0)."""
        if length == 1:
            return step < shards
        return bool(self.last_reached[length - 1]) and self.last_reached[length - 1] + shards > step

    def held(self, length: int, step: int, shards: int) -> bool:
        """Whether an open phrase of this length may need ``step``."""
        return bool(self.last_opened[length]) and self.last_opened[length] + shards > step + 1

    def lengths(self, step: int, shards: int) -> list[int]:
        """The lengths that ``step`` has to count."""
        return [n for n in range(1, LONGEST + 1) if step < n * (2 * shards - 1)
                and (self.active(n, step, shards) or self.held(n, step, shards))]


def last_step(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The step of each hash in a filter table, 0 where it is not present."""
    a, b = (table[place] for place in filter_places(hashes, len(table)))
    return np.where((a > 0) & (b > 0), np.maximum(a, b), 0)


def _longer(hashes: np.ndarray, next_word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    return mixed * _SPREAD + next_word


def count_block(words: pa.Array, of_word: np.ndarray, ids: np.ndarray, known: PhraseFilter, step: int, shards: int):
    """(phrases, counts) of the phrases of a block that may be active or open in ``step`` (from 0).

    A phrase may come more than once; its counts add up.  A length of which nothing is
    active or open costs no look-up.
    """
    lengths = known.lengths(step, shards)
    if not lengths or not len(words):
        return
    if 1 in lengths:
        counts = np.bincount(ids[ids >= 0], minlength=len(words))
        if known.active(1, step, shards):
            yield words, counts
        else:
            own = np.flatnonzero(last_step(known.opened[0], of_word).astype(np.int32) + shards > step + 1)
            yield words.take(pa.array(own)), counts[own]
    n = len(ids)
    places = np.arange(n, dtype=np.int32)
    next_break = np.minimum.accumulate(np.where(ids < 0, places, np.int32(n))[::-1])[::-1]
    room = next_break - places  # words from here to the end of the piece
    word_at = np.where(ids >= 0, of_word[ids], np.uint64(0))
    hashes = word_at.copy()  # of the phrase of ``length - 1`` words from each place on
    for length in range(2, min(max(lengths), n) + 1):
        if length in lengths:
            reached = np.zeros(n, np.uint8)
            shorter = np.flatnonzero(room >= length - 1)
            reached[shorter] = last_step(known.reached[length - 2], hashes[shorter])
            own = np.flatnonzero(room >= length)
            first, rest = reached[own], reached[own + 1]
            both = (first > 0) & (rest > 0)
            own, since = own[both], np.maximum(first, rest)[both].astype(np.int32)
            longer = _longer(hashes[own], word_at[own + length - 1])
            passed = since + shards > step
            if known.held(length, step, shards):
                later = np.flatnonzero(~passed)
                passed[later] = last_step(known.opened[length - 1], longer[later]).astype(np.int32) + shards > step + 1
            if passed.any():
                yield from _grouped(words, ids, own[passed], longer[passed], length)
        hashes[:n - length + 1] = _longer(hashes[:n - length + 1], word_at[length - 1:])


def _grouped(words: pa.Array, ids: np.ndarray, own: np.ndarray, hashes: np.ndarray, length: int):
    """The phrases at the places ``own`` and how often each stands there, some at a time."""
    order = np.argsort(hashes)
    own, hashes = own[order], hashes[order]
    new = hashes[1:] != hashes[:-1]
    for k in range(length):  # equal hashes of different phrases do not share a row
        new |= ids[own[1:] + k] != ids[own[:-1] + k]
    firsts = np.flatnonzero(np.concatenate([[True], new]))
    counts = np.diff(np.append(firsts, len(own)))
    for at in range(0, len(firsts), ROWS_OUT):
        starts = own[firsts[at:at + ROWS_OUT]]
        parts = [words.take(pa.array(ids[starts + k])) for k in range(length)]
        yield pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), counts[at:at + ROWS_OUT]


def _key_parts(key: bytes) -> tuple[str, bytes]:
    """Language and phrase of a key; a phrase holds no line end."""
    lang, _, phrase = key.rpartition(KEY_END)
    return lang.decode(), phrase


def _phrase_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and hash of each key's phrase."""
    parts = [_key_parts(key) for key in keys]
    words = [phrase.split(b" ") for _, phrase in parts]
    lengths = np.array([len(w) for w in words], np.int32)
    seed = {lang: _language_seed(lang) for lang in {lang for lang, _ in parts}}
    seeds = np.repeat(np.array([seed[lang] for lang, _ in parts], np.uint64), lengths)
    of_word = word_hashes(pa.array([w for own in words for w in own], pa.binary()), seeds)
    firsts = np.cumsum(lengths) - lengths
    found = of_word[firsts]
    for k in range(1, LONGEST):
        more = np.flatnonzero(lengths > k)
        found[more] = _longer(found[more], of_word[firsts[more] + k])
    return lengths, found


def _counted(blocks: DataFrame, known: Broadcast, step: int, shards: int) -> DataFrame:
    """(key, n): what one scan of a shard adds."""

    def scan(batches):
        for batch in batches:
            for row in range(batch.num_rows):  # one block at a time
                lang = batch.column(0)[row].as_py()
                words, ids = unpack_block(batch.column(1)[row], batch.column(2)[row])
                begin, of_word = pa.scalar(lang.encode() + KEY_END, pa.binary()), word_hashes(words, _language_seed(lang))
                for phrases, counts in count_block(words, of_word, ids, known.value, step, shards):
                    for at in range(0, len(phrases), ROWS_OUT):
                        part, n = phrases.slice(at, ROWS_OUT), counts[at:at + ROWS_OUT].astype(np.int64)
                        keys = pc.binary_join_element_wise(begin, part, pa.scalar(b"", pa.binary()))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(n)], ["key", "n"])
            del batch
        pa.default_memory_pool().release_unused()  # the worker waits for its next task with what it keeps

    return blocks.select("lang", "words", "ids").mapInArrow(scan, "key binary, n long")


def _mark(known: PhraseFilter, changed: DataFrame, step: int) -> None:
    """Enter the phrases that opened or reached the threshold; a bit a cell comes to the driver at most."""
    cells = known.opened.shape[1]
    width = min(cells, SEGMENT_CELLS)

    def hashed(batches):
        for batch in batches:
            lengths, found = _phrase_hashes(batch.column(0).to_pylist())
            places = np.concatenate(filter_places(found, cells)).astype(np.int64)
            flags = [np.tile(batch.column(c).to_numpy(zero_copy_only=False).astype(bool), 2) for c in (1, 2)]
            for kind, flag in enumerate(flags):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(int(flag.sum()), kind, np.int32)), pa.array(np.tile(lengths, 2)[flag]),
                     pa.array(places[flag] // width), pa.array(places[flag] % width)], ["kind", "length", "segment", "cell"])

    def packed(part: pd.DataFrame) -> pd.DataFrame:  # distinct cells of one segment: SEGMENT_CELLS rows at most
        bits = np.zeros(width, bool)
        bits[part["cell"]] = True
        return pd.DataFrame({"kind": part["kind"].iloc[:1], "length": part["length"].iloc[:1],
                             "segment": part["segment"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    found = changed.select("key", "opened", "newly").mapInArrow(hashed, "kind int, length int, segment long, cell long")
    segments = found.distinct().groupBy("kind", "length", "segment").applyInPandas(
        packed, "kind int, length int, segment long, bits binary")
    for r in segments.collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=width).astype(bool)
        if r["kind"] == 0:
            table, last = known.opened, known.last_opened
        elif r["length"] < LONGEST:
            table, last = known.reached, known.last_reached
        else:
            continue
        table[r["length"] - 1, r["segment"] * width:(r["segment"] + 1) * width][bits] = step + 1
        last[r["length"]] = step + 1


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_freed(spark):
    """Shuffle files of a query that runs in here are deleted as it ends."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


STATE = "key binary, code int, n long, opened boolean, newly boolean, closed boolean"


def count_phrases(shard_folder: str, spark, folder: str, threshold: int = 100, shards: int = SHARDS,
                  cells: int = FILTER_CELLS) -> DataFrame:
    """(lang, phrase, length, n): every phrase of 1 to 5 words with at least ``threshold`` occurrences, exactly counted."""
    blocks = spark.read.schema(f"{BLOCKS}, shard int").parquet(shard_folder)
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # ``shards`` rows
    used = sorted(sizes)
    share = -(-threshold // max(1, len(used)))  # some shard holds so many of a phrase at the threshold
    known = PhraseFilter(cells)
    state, step = spark.createDataFrame([], STATE), 0
    while used and known.lengths(step, len(used)):
        sent = spark.sparkContext.broadcast(known)
        shard = used[step % len(used)]
        # a task reads so many words that what it counts combines before the shuffle
        parts = blocks.where(F.col("shard") == shard).coalesce(max(1, -(-sizes[shard] // SCAN_WORDS)))
        added = _counted(parts, sent, step, len(used))
        # code: twice the first step, and 1 until the threshold is reached; an open phrase's own code is the smaller one
        rows = state.where("NOT closed").select("key", "code", "n").unionByName(
            added.select("key", F.lit(2 * step + 1).alias("code"), "n"))
        one = rows.groupBy("key").agg(F.min("code").alias("code"), F.sum("n").alias("n"))
        one = one.withColumn("opened", F.col("code") == 2 * step + 1).where(~F.col("opened") | (F.col("n") >= share))
        one = one.withColumn("newly", (F.col("code") % 2 == 1) & (F.col("n") >= threshold))
        one = one.withColumn("closed", F.floor(F.col("code") / 2) + len(used) <= step + 1)
        one = one.withColumn("code", F.col("code") - F.col("newly").cast("int"))
        path = f"{folder}/open-{step % 2}"
        # a phrase below the threshold is done with after its cycle
        one = one.where((F.col("n") >= threshold) | ~F.col("closed"))
        with shuffle_files_freed(spark):
            (one.select("key", "code", "n", "opened", "newly", "closed").write.mode("overwrite")
             .option("compression", "zstd").parquet(path))
        state = spark.read.schema(STATE).parquet(path)
        state.where("closed").select("key", "n").write.mode("append").parquet(f"{folder}/counted")
        _mark(known, state.where("opened OR newly"), step)
        sent.destroy()
        step += 1
        # what else a step shuffled, Spark deletes when the driver's collector finds its plan unused; the driver's heap
        # may not fill up for many steps, while the executors' disks do
        del rows, one, added, parts
        spark.sparkContext._jvm.System.gc()
    if not used:
        return spark.createDataFrame([], "lang string, phrase binary, length int, n long")
    found = spark.read.schema("key binary, n long").parquet(f"{folder}/counted").groupBy("key").agg(F.max("n").alias("n"))
    phrase = F.substring_index("text", KEY_END.decode(), -1)
    named = found.withColumn("text", F.col("key").cast("string")).withColumn("phrase", phrase)
    return named.select(F.expr("left(text, char_length(text) - char_length(phrase) - 1)").alias("lang"),
                        F.col("phrase").cast("binary").alias("phrase"),
                        (F.regexp_count("phrase", F.lit(" ")) + 1).alias("length"), "n")


def collocations(counts: DataFrame, n_words: DataFrame, top: int = 2000, share: int = 100, scale: int = 1000) -> DataFrame:
    """Each language's best phrases by their weakest cut.

    ``counts``: (lang, phrase, length, n) of all phrases at the threshold;
    ``n_words``: (lang, n) word occurrences.  Products are decimals of 38 digits.
    """
    phrases = counts.where("length > 1").select("lang", F.split(F.col("phrase").cast("string"), " ").alias("words"),
                                                F.col("n").alias("a"), "length")
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = (phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
            .select("lang", "words", "length", "a", "k", part(F.lit(1), F.col("k")).alias("first"),
                    part(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest")))
    known = counts.select(F.col("lang").alias("in_lang"), F.col("phrase").cast("string").alias("part"), F.col("n").alias("f"))
    found = (cuts.join(known, (F.col("lang") == F.col("in_lang")) & (F.col("first") == F.col("part")))
             .withColumnRenamed("f", "l").drop("in_lang", "part"))
    found = (found.join(known, (F.col("lang") == F.col("in_lang")) & (F.col("rest") == F.col("part")))
             .withColumnRenamed("f", "r").drop("in_lang", "part").join(n_words, "lang"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    found = found.withColumn("above", F.lit(scale).cast("decimal(10,0)") * big("a") * big("n"))
    found = found.withColumn("below", big("l") * big("r")).withColumn("score", F.expr("above div below"))
    weakest = found.groupBy("lang", "words", "length", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where("length > 2").select("lang", "words", "length", F.col("a").alias("above"))
    inside = (longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
              .withColumn("first", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
              .groupBy("lang", F.slice("words", F.col("first"), F.col("size")).alias("words"))
              .agg(F.max("above").alias("above")))
    kept = (weakest.join(inside, ["lang", "words"], "left")
            .where(F.col("above").isNull() | (100 * F.col("above") < share * F.col("a"))))
    named = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (named.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def mine_phrases(docs: DataFrame, threshold: int = 100, top: int = 2000, shards: int = SHARDS, text_col: str = "text",
                 lang_col: str = "lang", folder: str | None = None, block_words: int = BLOCK_WORDS,
                 cells: int = FILTER_CELLS) -> DataFrame:
    """The best phrases of each language; ``folder`` (default: under the checkpoint folder) holds shards and counts."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    write_shards(docs, f"{folder}/shards", shards, text_col, lang_col, block_words)
    counts = count_phrases(f"{folder}/shards", spark, f"{folder}/counts", threshold, shards, cells)
    totals = word_totals(spark, f"{folder}/shards")
    return collocations(counts, totals, top)


def word_totals(spark, shard_folder: str) -> DataFrame:
    """(lang, n): all word occurrences."""
    blocks = spark.read.schema(f"{BLOCKS}, shard int").parquet(shard_folder)
    return blocks.groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
