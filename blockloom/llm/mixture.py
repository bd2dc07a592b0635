"""Mixing sources to target weights of the total size in tokens.

The budget of the mix is spread down a tree (domain, language, source). A node that
cannot use its budget, because its documents may be repeated only so often, gives
the shortage to its siblings, and what they cannot take goes on to its parent's
siblings. Each leaf is then filled from seeded epochs: whole epochs first, then the
documents at the head of one more, by running sum of tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into words, numbers, other runs and blanks before the merges (fixed value of that vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a text may be cut without changing its tokens: before a single blank between two letters.
_GAP = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
#: Leaves of the tree that the driver plans at most.
MAX_LEAVES = 100_000


def with_tokens(docs: DataFrame, columns: Sequence[str], vocabulary: str = VOCABULARY, piece: int = 1 << 20) -> DataFrame:
    """`columns` and n_tokens of each document's whole text; a null or empty text has 0.

    Repeated rows are counted each; other columns are not read.

    vocabulary: a file of byte-level ranks that every executor can read. Texts of
    more than `piece` characters are counted piece by piece, cut where no token can
    reach over; the count is that of the whole.
    """
    columns = list(columns)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(text: str) -> int:
            total, at = 0, 0
            while len(text) - at > piece:
                # no token reaches over a blank between two other signs, so the pieces' counts add up
                gap = _GAP.search(text, at + piece)
                if gap is None:
                    break
                total += len(coder.encode_ordinary(text[at : gap.end()]))
                at = gap.end()
            return total + len(coder.encode_ordinary(text[at:] if at else text))

        for batch in batches:
            n = [size(t) if t else 0 for t in batch.column(len(columns)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    picked = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(count, f"{kinds}, n_tokens bigint")


class Node:
    """A node of the weight tree.

    weight: its part of its parent's budget. cap: what it can give at most, a leaf's
    tokens times its repeats. asked: the budget that weights alone give it; where that
    is more than its cap, the rest is its shortage. budget: what it gets in the end.
    """

    def __init__(self, name: str, weight: Fraction = Fraction(0), cap: int = 0):
        self.name, self.weight, self._cap, self.children = name, weight, cap, {}
        self.asked, self.budget = Fraction(0), Fraction(0)

    @property
    def cap(self) -> int:
        return sum(c.cap for c in self.children.values()) if self.children else self._cap

    @property
    def shortage(self) -> Fraction:
        return max(Fraction(0), self.asked - self.cap)

    def leaves(self, path: tuple = ()) -> Iterator[tuple[tuple, Node]]:
        for name, child in self.children.items():
            if child.children:
                yield from child.leaves((*path, name))
            else:
                yield (*path, name), child


def ask(node: Node, budget: Fraction) -> None:
    """Propagate a budget down by weight alone, exactly."""
    node.asked = budget
    total = sum(c.weight for c in node.children.values())
    for c in node.children.values():
        ask(c, budget * c.weight / total if total else Fraction(0))


def short(root: Node) -> list[str]:
    """Names of the sources, which are the leaves, that some shortage was found for."""
    return sorted({leaf.name for _, leaf in root.leaves() if leaf.shortage > 0})


def spread(node: Node, budget: Fraction) -> None:
    """Give `budget` to the node and on to its children by weight, no child more than its cap.

    What a full child cannot take is shared among its siblings by their weights (by
    their room where all remaining weights are zero), until all is given or all are
    full; what the siblings cannot take stays in the node's own shortage, which its
    parent has already given to the node's siblings.
    """
    caps = {n: c.cap for n, c in node.children.items()}
    node.budget = min(budget, sum(caps.values()) if caps else node.cap)
    given = dict.fromkeys(caps, Fraction(0))
    rest, open_ = node.budget, {n for n, c in caps.items() if c > 0}
    while open_ and rest > 0:
        total = sum(node.children[n].weight for n in open_)
        room = {n: caps[n] - given[n] for n in open_}
        all_room = sum(room.values())
        share = {n: rest * (node.children[n].weight / total if total > 0 else room[n] / all_room) for n in open_}
        full = {n for n in open_ if share[n] >= room[n]}
        for n in full or open_:
            given[n] += room[n] if full else share[n]
        rest = rest - sum(room[n] for n in full) if full else Fraction(0)
        open_ -= full
    for n, child in node.children.items():
        spread(child, given[n])


def plan(leaf_tokens: Sequence[tuple[str, str, str, int]], targets: dict[str, tuple[float, int]]) -> tuple[Node, int]:
    """The tree domain - language - source with its budgets, and the total: leaf_tokens are (domain, source, lang, tokens).

    targets: share and greatest number of repeats per source. A source's weight in a
    language is its share by its tokens there; a language and a domain weigh what is in
    them. A source without a target gets nothing; one without documents has a leaf of no
    language in a domain of its own, and its whole share is shortage. Shares that do not
    sum to 1 are taken as they are: a source is asked for share * total.
    """
    total = sum(n for *_, n in leaf_tokens)
    own: dict[str, list[int]] = {}
    for _, source, _, n in leaf_tokens:
        own.setdefault(source, []).append(n)
    root = Node("mix")

    def add(domain: str, lang: str, source: str, weight: Fraction, cap: int) -> None:
        d = root.children.setdefault(domain, Node(domain))
        d.children.setdefault(lang, Node(lang)).children[source] = Node(source, weight, cap)

    for domain, source, lang, n in leaf_tokens:
        share, repeats = targets.get(source, (0.0, 0))
        whole = sum(own[source])
        add(domain, lang, source, Fraction(share) * (Fraction(n, whole) if whole else Fraction(1, len(own[source]))), repeats * n)
    for source, (share, _) in targets.items():
        if source not in own:
            add(f"no {source}", "none", source, Fraction(share), 0)
    for d in root.children.values():
        for lang in d.children.values():
            lang.weight = sum((s.weight for s in lang.children.values()), Fraction(0))
        d.weight = sum((x.weight for x in d.children.values()), Fraction(0))
    ask(root, total * sum((d.weight for d in root.children.values()), Fraction(0)))
    spread(root, Fraction(total))
    return root, total


def select_prefixes(docs: DataFrame, budgets: DataFrame, seed: int = 42, ranges: int | None = None) -> DataFrame:
    """doc columns, copies: how often each document is used to fill its leaf's budget.

    docs: leaf, doc_id, n_tokens, .... budgets: leaf, tokens (of all its documents),
    budget. Every epoch has its own order, seeded by its number; a budget takes whole
    epochs, then the documents at the head of the next one while the running sum of
    tokens stays within what is left, so a leaf's total is at most its budget and
    falls short by less than one document. Sums run over `ranges` (a power of two) of the
    seeded order, each of which one task sums; the ranges' totals come first. Without
    it there are as many as give a range about a hundred thousand documents. Ties in
    the order go by doc_id. A column `copies` of docs is replaced; rows without a budget's
    leaf are left out. Documents of no tokens take part in whole epochs only.
    """
    if ranges is None:
        ranges = 1 << max(6, (docs.count() // 100_000).bit_length())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("_row")
    budgets = budgets.select("leaf", "tokens", "budget")
    ready = docs.select("leaf", "doc_id", "n_tokens", row).join(F.broadcast(budgets) if _small(budgets) else budgets, "leaf")
    whole = F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))).cast("bigint")
    ready = ready.withColumn("epochs", F.when(F.col("tokens") > 0, whole).otherwise(F.lit(0).cast("bigint")))
    ready = ready.withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")).withColumn("place", F.xxhash64(F.lit(seed), "epochs", "doc_id"))
    ready = ready.withColumn("range", F.shiftrightunsigned("place", 64 - (ranges.bit_length() - 1)))
    sums = ready.groupBy("leaf", "range").agg(F.sum("n_tokens").alias("_sum"))
    before = sums.withColumn("before", F.coalesce(F.sum("_sum").over(W.partitionBy("leaf").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    running = F.sum("n_tokens").over(W.partitionBy("leaf", "range").orderBy(F.col("place"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    chosen = ready.withColumn("_run", running).join(before, ["leaf", "range"]).withColumn("copies", F.col("epochs") + ((F.col("before") + F.col("_run") <= F.col("left")) & (F.col("n_tokens") > 0)).cast("bigint"))
    return chosen.select("_row.*", "copies")


def _small(df: DataFrame) -> bool:
    """A budgets table is made on the driver from at most MAX_LEAVES rows."""
    return df.limit(MAX_LEAVES + 1).count() <= MAX_LEAVES
