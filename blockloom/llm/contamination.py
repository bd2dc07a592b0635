"""Evaluation passages that appear in documents.

A passage is a run of consecutive words of an item. The search is a prefix-filtered
set join: an item's windows are sets of word shingles, shingles are ordered by how
rare they are over all documents, and since a document must hold every shingle of a
window, only the rarest one of each window has to be joined. Position bounds and a
word-by-word comparison over the window confirm what the join proposes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.mail import view, words
from blockloom.session import written

#: Bits of the filter over item shingles that is sent to every task at most: 64 MB.
MOST_BITS = 1 << 29
#: Tasks over which the documents of one shingle are spread.
SALTS = 8
#: Weight of a word by its place in the shingle; odd, so that no place is lost.
_STEP = 0x9E3779B97F4A7C15
#: Odd numbers that spread a key over the filter.
_TURNS = np.array([_STEP, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _hashes(tokens: Sequence[str], known: dict[str, int]) -> list[int]:
    """The 64-bit hash of each word; `known` keeps those it has met."""
    out = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            h = known[t] = xxhash.xxh64_intdigest(t)
        out.append(h)
    return out


def _rolled(each: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` word hashes, by start; as signed integers."""
    count = max(0, len(each) - size + 1)
    out = np.zeros(count, np.uint64)
    for i in range(size if count else 0):
        out = out * np.uint64(_STEP) + each[i : i + count]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def shingles(tokens: Sequence[str], size: int, known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes of the runs of `size` words, by start; as signed integers."""
    return _rolled(np.array(_hashes(tokens, {} if known is None else known), np.uint64), size)


def item_windows(items: DataFrame, window: int, size: int) -> DataFrame:
    """item_id, start, words, keys: every window of every item with its shingles. Shorter items have none."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = words(text or "")
                keys = shingles(tokens, size)
                rows += [(item, i, " ".join(tokens[i : i + window]), keys[i : i + window - size + 1].tolist()) for i in range(len(tokens) - window + 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())], strict=True)], names=["item_id", "start", "words", "keys"]
            )

    return items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter("item_id is not null").mapInArrow(split, "item_id bigint, start int, words string, keys array<bigint>")


def _trim(known: dict) -> None:
    if len(known) > 200_000:
        known.clear()


class Bloom:
    """Which shingles can be one of the items': a bit set that never misses one, of at most `MOST_BITS`."""

    def __init__(self, bits: np.ndarray):
        self.words, self.size = bits, np.uint64(len(bits) * 64 - 1)

    @staticmethod
    def places(keys: np.ndarray, mask: np.uint64, turn: int) -> np.ndarray:
        """The bit of each key in one of the three turns."""
        k = keys.view(np.uint64)
        return ((k ^ (k >> np.uint64(32))) * _TURNS[turn] >> np.uint64(7)) & mask

    def __contains__(self, key: int) -> bool:
        return len(self.held(np.array([key], np.int64))) > 0

    def held(self, keys: np.ndarray) -> np.ndarray:
        """Indices of the keys that may be in the set; later turns look only at what earlier ones left."""
        left = np.arange(len(keys))
        for turn in range(len(_TURNS)):
            at = self.places(keys[left] if turn else keys, self.size, turn)
            left = left[(self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0]
            if not len(left):
                break
        return left


def bloom_of(keys: DataFrame, most_bits: int = MOST_BITS) -> Bloom:
    """The filter of a column of 64-bit keys, of 16 bits a key as far as `most_bits` allow; made by the tasks, joined in a few more."""
    n = max(1, keys.count())
    size = 1 << min(most_bits.bit_length() - 1, max(10, (16 * n - 1).bit_length()))
    piece = max(1, size // 64 // 256)  # words of the filter per row

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_ = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for turn in range(len(_TURNS)):
                at = Bloom.places(batch.column(0).to_numpy(zero_copy_only=False), np.uint64(size - 1), turn)
                np.bitwise_or.at(words_, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        for i in range(0, len(words_), piece):
            part = words_[i : i + piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // piece], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["i", "part"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                now = np.frombuffer(part, np.uint64)
                held[i] = held[i] | now if i in held else now
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "part"])

    marked = keys.select("key").coalesce(32).mapInArrow(mark, "i int, part binary").repartition("i").mapInArrow(join, "i int, part binary")
    whole = np.zeros(size // 64, np.uint64)
    for r in marked.toLocalIterator():
        part = np.frombuffer(bytes(r.part), np.uint64)
        whole[r.i * piece : r.i * piece + len(part)] |= part
    return Bloom(whole)


def _stretches(docs: DataFrame, wanted, window: int, size: int, read: Callable[[str | None], list[str]]) -> DataFrame:
    """doc_id, stretch, words, hits(pos, key): the stretches of each document around shingles that pass the filter.

    A stretch has every word that a window over one of its hits can take in, and a number
    of its own. Rows with
    stretch -1 tell, in `hits`, in how many documents (pos) a shingle (key) occurs, as
    far as one task has read: of all documents, whether they have a stretch or not.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve: Bloom = wanted.value
        known: dict[str, int] = {}
        counted: list[np.ndarray] = []
        total = 0

        def tallied() -> Iterator[pa.RecordBatch]:
            nonlocal total
            keys, n = np.unique(np.concatenate(counted), return_counts=True) if counted else (np.zeros(0, np.int64), [])
            counted.clear()
            total = 0
            for i in range(0, len(keys), 4096):
                hits = [{"pos": int(c), "key": int(k)} for k, c in zip(keys[i : i + 4096], n[i : i + 4096], strict=True)]
                yield rows([None], [-1], [""], [hits])

        def rows(ids, marks, texts, hits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.int64())])))],
                names=["doc_id", "stretch", "words", "hits"],
            )

        reach = window - size
        mark = TaskContext.get().partitionId() << 40

        def settled(docs_: list[int], parts: list[list[str]], each: list[int]) -> pa.RecordBatch:
            """The stretches of some parts of documents, whose words' hashes are `each` one after the other."""
            nonlocal total, mark
            ends = np.cumsum([len(p) for p in parts])
            starts = ends - [len(p) for p in parts]
            keys = _rolled(np.array(each, np.uint64), size)
            at = sieve.held(keys)
            part = np.searchsorted(ends, at, side="right")
            inside = at + size <= ends[part]  # no shingle crosses from one part to the next
            at, part = at[inside], part[inside]
            out: tuple = ([], [], [], [])
            for group in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(part) > 0)) + 1) if len(at) else []:
                # of fewer shingles than a window has, no window can be made
                if len(group) <= reach:
                    continue
                p = int(part[group[0]])
                low, tokens = int(starts[p]), parts[p]
                first, last = max(0, int(at[group[0]]) - low - reach), min(len(tokens), int(at[group[-1]]) - low + window)
                mark += 1
                for column, value in zip(out, (docs_[p], mark, " ".join(tokens[first:last]), [{"pos": int(at[i]) - low - first, "key": int(keys[at[i]])} for i in group]), strict=True):
                    column.append(value)
            if len(at):
                # a document's parts are settled together, so it counts a shingle once
                doc = np.unique(np.array(docs_, np.int64), return_inverse=True)[1][part]
                order = np.lexsort((keys[at], doc))
                k, d = keys[at][order], doc[order]
                once = np.ones(len(k), bool)
                once[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                counted.append(k[once])
                total += len(counted[-1])
            return rows(*out)

        docs_, parts, each = [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for tokens in map(words, read(text)):
                    docs_.append(doc)
                    parts.append(tokens)
                    each += _hashes(tokens, known)
                _trim(known)
                if len(each) > 1 << 17:
                    yield settled(docs_, parts, each)
                    docs_, parts, each = [], [], []
            if total > 1 << 20:
                yield from tallied()
        if parts:
            yield settled(docs_, parts, each)
        yield from tallied()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null").mapInArrow(scan, "doc_id bigint, stretch bigint, words string, hits array<struct<pos:int,key:bigint>>")


def leaked_windows(docs: DataFrame, items: DataFrame, window: int = 13, size: int = 5, read: Callable[[str | None], list[str]] = view, broadcast_limit: int = MOST_BITS) -> DataFrame:
    """Distinct doc_id, item_id, start: windows of items that a document holds word for word.

    docs: doc_id, text. items: item_id, text. read: the texts a reader sees of a
    document; no window crosses from one to the next. Words are runs of letters and
    digits in lower case. Null and empty texts, and items shorter than the window,
    hold nothing; repeated rows count once; other columns are not read. Texts are
    read whole, every document is compared with every item, and no candidate is
    capped.

    One plan for all sizes: a bit set of the items' shingles, of at most
    `broadcast_limit` bits, is sent to the tasks that read the documents, so only
    stretches that can hold a window leave them. With more items than it has room for
    it lets more through, and the joins that follow still decide. Only a window's
    rarest shingle, by the number of documents that hold it, is joined; a shingle that
    many documents share is spread over `SALTS` tasks.
    """
    if not 0 < size <= window:
        raise ValueError("size must be between 1 and window")
    spark = docs.sparkSession
    wins = written(item_windows(items, window, size).distinct(), "windows")
    wanted = spark.sparkContext.broadcast(bloom_of(wins.select(F.explode("keys").alias("key")).distinct(), max(1 << 10, broadcast_limit)))
    read_ = written(_stretches(docs, wanted, window, size, read), "stretches")
    near = read_.filter("stretch >= 0")
    hits = near.select("doc_id", "stretch", F.inline("hits"))
    # how many documents hold a shingle; one that none holds rules its windows out
    rarity = read_.filter("stretch < 0").select(F.inline("hits")).groupBy("key").agg(F.sum("pos").alias("n_docs"))
    held = wins.select("item_id", "start", "words", F.posexplode("keys").alias("offset", "key")).join(rarity, "key")
    prefix = (
        held.groupBy("item_id", "start", "words").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("n_docs", "key", "offset")).alias("rarest"))
        .filter(F.col("n") == window - size + 1)
        .select("item_id", "start", F.col("words").alias("item_words"), F.col("rarest.key").alias("key"), F.col("rarest.offset").alias("offset"))
    )
    salted = prefix.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    first = F.col("pos") - F.col("offset")
    proposed = hits.withColumn("salt", F.pmod(F.hash("stretch"), F.lit(SALTS))).join(salted, ["key", "salt"]).filter(first >= 0).select("doc_id", "stretch", first.alias("first"), "item_id", "start", "item_words")
    return (
        proposed.join(near.select("stretch", "words"), "stretch")
        .filter(F.array_join(F.slice(F.split("words", " "), F.col("first") + 1, window), " ") == F.col("item_words"))
        .select("doc_id", "item_id", "start").distinct()
    )


def leak_report(leaks: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """item_id, n_docs, longest: documents per leaked item and the most words in a row that one of them holds."""
    runs = leaks.withColumn("_island", F.col("start") - F.expr("row_number() over (partition by doc_id, item_id order by start)"))
    per = runs.groupBy("doc_id", "item_id", "_island").agg((F.count(F.lit(1)) + window - 1).alias("n_words"))
    found = per.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest"))
    return items.select("item_id", "task").distinct().join(found, "item_id")
