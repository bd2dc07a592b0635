"""Severity of abusive language, by cumulative-link ordinal regression.

A document is as severe as its worst sentence. Sentences become sparse features:
hashed words and word pairs, spelled so that common disguises (digits for letters,
look-alike letters, stretched, spaced or starred words) meet the plain spelling. One
weight vector is shared by all thresholds between neighbouring grades; a document's
grade during training is that of the sentence which scores highest so far.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.mail import view
from blockloom.session import written

#: Hashed features; the weights take 4 bytes each wherever they are sent.
FEATURES = 1 << 18
#: Labelled documents that are used to fit at most (those of the lowest hash of doc_id).
MAX_LABELLED = 20_000

# Letters of other scripts that look like Latin ones, and signs used for letters.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвгпαεοιυνκρτ", "aeopcyxijsdhkmtbrnaeoiuvkpt")
_SIGNS = str.maketrans("0134578@$!|€", "oieastba" + "siie")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_TOKEN = re.compile(r"\n|[^\W_][\w*@$!|€'’#]*(?:(?<=\*)[\w*]+)?|\*+\w+")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_REPEAT = re.compile(r"([^\W\d_])\1+")
_BREAK = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|:\s*\n|\n\s*\n|\n(?=[ \t]+\S)|\n(?=\s*(?:==|[*•#-] |\d+[.)] ))")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")


#: Words of a unit at most; a longer sentence is read in windows that overlap by half.
LONGEST = 24


def sentences(text: str) -> list[str]:
    """Sentences of one part: cut after . ! ? and at blank lines, indents, headings and list marks; other line ends are blanks.

    A sentence of more than `LONGEST` words (code, tables, lost full stops) gives its
    windows instead, so that a short insult in it is not thinned out.
    """
    out = []
    for s in _BREAK.split(text):
        w = s.split()
        if len(w) > LONGEST:
            step = LONGEST // 2
            out += [" ".join(w[i : i + LONGEST]) for i in range(0, len(w) - step, step)]
        elif w:
            out.append(" ".join(w))
    return out


def plain_text(text: str) -> str:
    """Lower case, without invisible signs and look-alike letters; spaced words are joined."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower().translate(_LOOKALIKES)
    return _SPACED.sub(lambda m: m[0].replace(" ", ""), text.lower())


def spellings(raw: str) -> tuple[str | None, str] | None:
    """(plain spelling or None if starred, starred spelling) of a token; None if it is no word.

    The starred spelling keeps the first letter and all from the fourth on, so that
    a word and its starred form share it.
    """
    raw = raw.strip("'’#").rstrip("!|")
    if not raw:
        return None
    if raw.isdigit():
        return "0", "0"
    if not raw.isalpha():
        raw = raw.translate(_SIGNS)
    plain = "".join(c for c in unicodedata.normalize("NFD", raw) if c.isalnum() or c == "*")
    if not plain:
        return None
    if "*" in plain:
        return None, f"{plain[0]}**{_REPEAT.sub(r'\1', plain[3:])}"
    once = _REPEAT.sub(r"\1", plain)
    return once, f"{plain[0]}**{_REPEAT.sub(r'\1', plain[3:])}" if len(plain) > 3 else once


class Encoder:
    """Turns sentences into feature indices; keeps the hashes of words it has met."""

    def __init__(self, size: int = FEATURES):
        self.shift, self.known = np.uint64(64 - size.bit_length() + 1), {}

    def _hashes(self, raw: str) -> tuple[int, int]:
        both = spellings(raw)
        return (0, 0) if both is None else (xxhash.xxh64_intdigest(both[0]) | 1 if both[0] is not None else 0, xxhash.xxh64_intdigest(both[1]) | 1)

    def words(self, units: Sequence[str]) -> list[tuple[int, int, int]]:
        """(plain hash or 0, starred hash, number of the sentence) of each word."""
        known, out, at = self.known, [], 0
        if len(known) > 300_000:
            known.clear()
        for raw in _TOKEN.findall(plain_text("\n".join(units))):
            if raw == "\n":
                at += 1
                continue
            h = known.get(raw)
            if h is None:
                h = known[raw] = self._hashes(raw)
            if h[1]:
                out.append((*h, at))
        return out

    def encode(self, words: Sequence[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature indices and the sentence of each: single words and pairs at distance 1 and 2, plain and starred."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        plain, star, at = (np.array(c, t) for c, t in zip(zip(*words, strict=True), (np.uint64, np.uint64, np.int64), strict=True))
        found, where = [], []
        for kind, h in enumerate((star, plain)):
            found.append(h[h > 0] * _MIX[kind])
            where.append(at[h > 0])
            for gap in (1, 2):
                same = (at[gap:] == at[:-gap]) & (h[gap:] > 0) & (h[:-gap] > 0)
                found.append((h[:-gap][same] ^ (h[gap:][same] * _MIX[2 + gap])) * _MIX[kind] + np.uint64(gap))
                where.append(at[gap:][same])
        x = np.concatenate(found)
        x = (x ^ (x >> np.uint64(31))) * _MIX[2]
        return (x >> self.shift).astype(np.int32), np.concatenate(where)

    def rows(self, units: Sequence[str]) -> list[np.ndarray]:
        """The feature indices of each sentence."""
        index, where = self.encode(self.words(units))
        order = np.argsort(where, kind="stable")
        return np.split(index[order], np.searchsorted(where[order], np.arange(1, len(units)))) if units else []


def units(text: str | None) -> list[str]:
    """All sentences a reader sees, repeated ones once."""
    return list(dict.fromkeys(s for part in view(text) for s in sentences(part)))


@dataclass(frozen=True)
class Model:
    """Shared weights and the ordered thresholds between grades 0, 1, 2, ..."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, index: np.ndarray, where: np.ndarray, count: int) -> np.ndarray:
        """Score of each of `count` sentences from the features in them."""
        n = np.bincount(where, minlength=count)
        return np.bincount(where, self.weights[index], minlength=count) / np.sqrt(np.maximum(n, 1))

    def expected(self, scores: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of the chance to be above."""
        return (1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -30, 30)))).sum(axis=1)

    def save(self, spark: SparkSession, path: str) -> None:
        """Keep the model in a folder, so that it is fit once and applied often."""
        spark.createDataFrame([(self.weights.tobytes(), self.thresholds.tolist())], "weights binary, thresholds array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        row = spark.read.parquet(path).first()
        return Model(np.frombuffer(bytes(row.weights), np.float32), np.array(row.thresholds))


def fit(docs: Sequence[tuple[list[np.ndarray], int]], **options) -> Model:
    """`fit_flat` on (features of each sentence, grade) of each document."""
    rows = [r for d, _ in docs for r in d]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d, _ in docs])
    index = np.concatenate([np.zeros(0, np.int32), *rows])
    where = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return fit_flat(index, where, owner, np.array([g for _, g in docs], np.int64), **options)


def fit_flat(index: np.ndarray, where: np.ndarray, owner: np.ndarray, grade: np.ndarray, grades: int = 3, rounds: int = 6, steps: int = 30, rate: float = 0.15, l2: float = 0.01, size: int = FEATURES) -> Model:
    """Fit on documents' sentences: feature `index[k]` is in sentence `where[k]`, which is in document `owner[where[k]]`.

    Every sentence of a document of grade 0 has grade 0; of another document only
    the sentence with the highest score has its grade, and the choice is made anew
    in each round (first by how much more often its features occur in documents of
    higher grades). Without a document above grade 0, or without one of it, the model
    scores every sentence alike.
    """
    thresholds = np.arange(1.0, grades) - 0.5
    weights = np.zeros(size)
    count, n_docs = len(owner), len(grade)
    if not len(index) or not (grade > 0).any() or not (grade == 0).any():
        return Model(weights.astype(np.float32), thresholds + 3)
    lengths = np.bincount(where, minlength=count)
    scale = 1 / np.sqrt(np.maximum(lengths, 1))
    seen = np.unique(owner[where].astype(np.int64) * size + index)
    hold, up = np.bincount(seen % size, minlength=size), np.bincount(seen[grade[seen // size] > 0] % size, minlength=size)
    del seen

    # start: log odds of a feature by the documents that hold it
    base = (grade > 0).mean()
    odds = np.log((up + base) / (hold - up + 1 - base) * (1 - base) / base) * np.sqrt(up)
    score = np.bincount(where, odds[index], minlength=count) * scale

    low = np.flatnonzero((grade[owner] == 0) & (lengths > 0))
    m1, m2, t1, t2, step = np.zeros(size), np.zeros(size), np.zeros(grades - 1), np.zeros(grades - 1), 0
    per_doc = np.bincount(owner, minlength=n_docs)
    for _ in range(rounds):
        order = np.lexsort((score, owner))
        best = order[np.append(owner[order][1:] != owner[order][:-1], True)]
        best = best[grade[owner[best]] > 0]
        used = np.concatenate([low, best])
        target = np.concatenate([np.zeros(len(low), np.int64), grade[owner[best]]])
        weight = np.concatenate([1 / np.sqrt(per_doc[owner[low]]), np.full(len(best), max(1.0, len(low) / max(len(best), 1) / 20))])
        weight /= weight.sum()
        place = np.full(count, -1)
        place[used] = np.arange(len(used))
        mine = place[where] >= 0
        at, to = index[mine], place[where[mine]]
        for _ in range(steps):
            step += 1
            s = np.bincount(to, weights[at], minlength=len(used)) * scale[used]
            # the grade lies between the thresholds around it: log(F(upper) - F(lower))
            above = 1 / (1 + np.exp(-np.clip(s[:, None] - thresholds, -30, 30)))
            reach = np.hstack([np.ones((len(used), 1)), above, np.zeros((len(used), 1))])
            hi, lo = reach[np.arange(len(used)), target], reach[np.arange(len(used)), target + 1]
            # d log(hi - lo) / d s = 1 - hi - lo; for a threshold, its own part of that
            pull = (1 - hi - lo) * weight
            gap = np.maximum(hi - lo, 1e-12)
            g_w = -np.bincount(at, (pull * scale[used])[to], minlength=size) + l2 * weights / size**0.5
            g_t = np.zeros(grades - 1)
            for k in range(grades - 1):
                slope = above[:, k] * (1 - above[:, k])
                g_t[k] = (weight * slope * ((target == k + 1) / gap * 1.0 - (target == k) / gap)).sum()
            m1, m2 = 0.9 * m1 + 0.1 * g_w, 0.999 * m2 + 0.001 * g_w**2
            t1, t2 = 0.9 * t1 + 0.1 * g_t, 0.999 * t2 + 0.001 * g_t**2
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            weights -= rate * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-6)
            thresholds = np.maximum.accumulate(thresholds - rate * (t1 / fix1) / (np.sqrt(t2 / fix2) + 1e-6))
        score = np.bincount(where, weights[index], minlength=count) * scale
    return Model(weights.astype(np.float32), thresholds)


def grade_labels(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 2 if all raters call it abusive, 1 if they disagree, 0 if none does.

    Null labels count for nothing; of one rater's repeated labels the highest counts.
    """
    once = labels.filter("abusive is not null and doc_id is not null").groupBy("doc_id", "rater").agg(F.max("abusive").alias("abusive"))
    return once.groupBy("doc_id").agg(F.when(F.min("abusive") > 0, 2).when(F.max("abusive") > 0, 1).otherwise(0).cast("int").alias("grade"))


_CODED = "doc_id bigint, grade int, n int, index array<int>, at array<int>"


def _coded(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """The features of at most `limit` labelled documents, chosen by hash of doc_id: the number of their sentences, and each feature with its sentence."""
    graded = grade_labels(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder()
        for batch in batches:
            sizes, indices, wheres = [], [], []
            for text in batch.column(2).to_pylist():
                found = units(text)
                index, where = coder.encode(coder.words(found))
                sizes.append(len(found))
                indices.append(index)
                wheres.append(where.astype(np.int32))
            cols = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(indices, pa.list_(pa.int32())), pa.array(wheres, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "grade", "n", "index", "at"])

    # the sample is bounded by `limit`, so it is sent to the documents instead of shuffling their texts
    picked = docs.select("doc_id", "text").join(F.broadcast(graded), "doc_id").select("doc_id", "grade", F.col("text").cast("string"))
    return picked.mapInArrow(split, _CODED)


def _flat(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Features, the sentence of each, the document of each sentence, and the grades, of documents in a fixed order."""
    t = table.sort_by([("doc_id", "ascending"), ("n", "ascending")])
    n = t["n"].to_numpy()
    index, at = (t[c].combine_chunks().flatten().to_numpy() for c in ("index", "at"))
    each = np.diff(t["index"].combine_chunks().offsets.to_numpy())
    return index, at + np.repeat(np.cumsum(n) - n, each), np.repeat(np.arange(len(n)), n), t["grade"].to_numpy().astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fit on at most `limit` labelled documents, chosen by hash of doc_id.

    One task fits; only the weights come to the driver. Of repeated documents each
    row counts.
    """

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        model = fit_flat(*_flat(pa.Table.from_batches(held))) if held else fit([])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))], names=["weights", "thresholds"])

    got = _coded(docs, labels, limit).repartition(1).mapInArrow(learn, "weights binary, thresholds array<double>").collect()
    return Model(np.frombuffer(bytes(got[0].weights), np.float32), np.array(got[0].thresholds)) if got else fit([])


def cross_validate(docs: DataFrame, labels: DataFrame, folds: int = 5, l2s: Sequence[float] = (0.001, 0.01, 0.1), limit: int = MAX_LABELLED) -> DataFrame:
    """l2, doc_id, grade, severity: each labelled document as a model sees it that was fit without it.

    For the choice of the regularisation and of the severity from which a document
    counts, by the labels alone. Each of the folds x l2s fits is a task of its own,
    which holds the bounded sample.
    """
    sample = written(_coded(docs, labels, limit).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(folds)).cast("int")), "sample")
    plans = F.array(*[F.struct(F.lit(float(x)).alias("l2"), F.lit(k).alias("out")) for x in l2s for k in range(folds)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            # a task may have got several fits
            for key in {*zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)}:
                mine = (batch.column(6).to_numpy() == key[0]) & (batch.column(7).to_numpy() == key[1])
                held.setdefault(key, []).append(batch.filter(pa.array(mine)))
        for (l2, out), parts in held.items():
            table = pa.Table.from_batches(parts)
            inside = table["fold"].to_numpy() != out
            model = fit_flat(*_flat(table.filter(pa.array(inside))), l2=l2)
            for row in table.filter(pa.array(~inside)).to_pylist():
                index, at = np.array(row["index"], np.int64), np.array(row["at"], np.int64)
                top = model.scores(index, at, row["n"]).max() if row["n"] else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([l2]), pa.array([row["doc_id"]], pa.int64()), pa.array([row["grade"]], pa.int32()), pa.array(model.expected(np.array([top])))], names=["l2", "doc_id", "grade", "severity"])

    return sample.select("*", F.explode(plans).alias("p")).select("doc_id", "grade", "n", "index", "at", "fold", "p.l2", "p.out").repartition(folds * len(l2s), "l2", "out").mapInArrow(judge, "l2 double, doc_id bigint, grade int, severity double")


def score(docs: DataFrame, model: Model, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """columns, severity: expected grade (0 to 2) of each document's worst sentence.

    Every document gets a row; null and empty texts have the severity of no evidence
    at all. Whole texts are read.
    """
    columns = list(columns)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = sent.value
        coder = Encoder(len(m.weights))
        known: dict[str, float] = {}

        def settle(texts: list[list[str]]) -> list[float]:
            """The highest score of each document; sentences that were met before (quoted ones, forms) keep theirs."""
            fresh = list(dict.fromkeys(u for t in texts for u in t if u not in known))
            known.update(zip(fresh, m.scores(*coder.encode(coder.words(fresh)), len(fresh)).tolist(), strict=True))
            top = [max((known[u] for u in t), default=0.0) for t in texts]
            if len(known) > 200_000:
                known.clear()
            return top

        for batch in batches:
            worst: list[float] = []
            held, size = [], 0
            for text in batch.column(len(columns)).to_pylist():
                held.append(units(text))
                size += len(text or "")
                if size > 1 << 20:
                    worst += settle(held)
                    held, size = [], 0
            worst += settle(held)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(m.expected(np.array(worst, float)), pa.float64())], names=[*columns, "severity"])

    picked = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(rate, f"{kinds}, severity double")
