import pytest
from hypothesis import given
from hypothesis import strategies as st

from blockloom.operators.builder import next_step
from blockloom.plans.blocks import BlockSet, batches, islands, lossless, resolve_bounds
from blockloom.plans.pruning import classify, conjuncts, is_pruner, kept, merged, simple_bounds, surviving


@given(st.lists(st.integers(0, 300)), st.integers(1, 20))
def test_chunks_lose_nothing(numbers, n):
    whole = BlockSet.of(numbers)
    parts = whole.chunks(n)
    assert list(lossless(parts)) == sorted(set(numbers)) == list(whole)
    assert len(parts) <= n and (not parts or max(map(len, parts)) - min(map(len, parts)) <= 1)


def test_chunk_counts():
    assert len(BlockSet.of([1, 2, 3, 4, 5]).chunks(8)) == 5
    assert sum(map(len, BlockSet.span(0, 10).chunks(4))) == 10
    assert BlockSet.span(5, 5).chunks(3) == []
    assert [len(b) for b in batches(BlockSet.span(0, 250), 100)] == [84, 83, 83]


def test_clip():
    assert BlockSet.of([1, 2, 9]).clip(2, 9).ranges == ((2, 3),)


@pytest.mark.parametrize(("numbers", "want"), [([0, 1, 2, 6, 7, 100, 101], {(0, 3), (6, 8), (100, 102)}), ([], set()), ([0], {(0, 1)}), ([3, 3, None, 4, 5, 8, 7, 9, 15, 16, 17], {(3, 6), (7, 10), (15, 18)})])
def test_islands(spark, numbers, want):
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    for width in (4, 1 << 20):
        assert {tuple(r) for r in islands(df, "n", width).collect()} == want


def test_bounds():
    assert resolve_bounds(100, last_n=10) == (91, 101)
    assert resolve_bounds(100, start=5, end=50) == (5, 50)
    assert resolve_bounds(100, has_filter=True) == (0, 101)
    assert resolve_bounds(100, start=95, last_n=10, has_filter=True) == (95, 101)
    assert resolve_bounds(5, last_n=100) == (0, 6)
    assert resolve_bounds(100, start=60, end=50) == (60, 60)
    for bad in (dict(head=10), dict(head=10, start=5), dict(head=None, last_n=3)):
        with pytest.raises(ValueError):
            resolve_bounds(**bad)


def test_steps():
    assert next_step(0, 1000, None, 2500) == next_step(0, 1000, 5000, 0)
    assert next_step(2000, 1000, None, 2500).end == 2501
    assert next_step(0, 1000, 25, 9).kind == "last"
    assert next_step(3000, 1000, None, 2500).kind == "done"


@pytest.mark.parametrize(
    ("text", "prunes"),
    [
        ("7 > 6", True), ("b > 40 AND b < 90", True), ("b > 40 AND other < 90", False), ("floor(b / 100) > 0", True), ("b IN (1, 2)", True), ("b BETWEEN 1 AND 2", True),
        ("NOT b IS NULL", True), ("(b > 1) IS TRUE", True), ("CASE WHEN b > 1 THEN true END", True), ("CAST(b AS STRING) LIKE '1%'", True), ("try_cast(b AS INT) = 1", True), ("-b < 0", True),
        ("b IN (SELECT 1)", False), ("exists(SELECT 1)", False), ("b > (SELECT 1)", False), ("rand() > 0.5", False), ("sum(b) > 1", False), ("row_number() OVER (ORDER BY b) > 1", False), ("b >", False),
        ("b = length('SELECT rand()')", True),
    ],
)
def test_classifier(spark, text, prunes):
    assert is_pruner(spark, text, "b") is prunes


def test_conjuncts(spark):
    assert len(conjuncts(spark, "a > 1 AND (b < 2 OR c = 3) AND d BETWEEN 1 AND 2")) >= 3
    prune, rest = classify(spark, ["b > 1 AND x = 'a AND b'", "b < 9"], "b")
    assert len(prune) == 2 and len(rest) == 1


def _parts(n, size):
    return [(i * size, (i + 1) * size) for i in range(n)]


def test_surviving(spark):
    assert surviving(spark, ["floor(b / 100) > 0"], "b", _parts(5, 100)) == {100, 200, 300, 400}
    assert surviving(spark, ["floor(b / 100) > 0"], "b", _parts(1, 10_000)) == {0}
    assert surviving(spark, ["b > 900 OR b < 100"], "b", _parts(10, 100)) == {0, 900}
    assert surviving(spark, ["100 / b > 1"], "b", _parts(3, 100)) == {0, 100, 200}  # fails at 0: nothing is left out
    assert surviving(spark, [], "b", _parts(3, 100)) == {0, 100, 200}
    assert surviving(spark, ["b > 1"], "b", []) == set()


def test_merged_filters(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "b")
    filters = ["b >= 100", "b >= 400"]
    assert df.filter(merged(filters)).count() == kept(df, filters).count() == 600
    assert df.filter(merged([])).count() == 1000


def test_simple_bounds(spark):
    assert simple_bounds(spark, ["(b >= 5L)", "`b` < 90", "b % 2 = 0", "c < 3"], "b") == (5, 90)
    assert simple_bounds(spark, ["b = 7"], "b") == (7, 8) and simple_bounds(spark, ["b > 7", "b <= 9"], "b") == (8, 10)
    assert surviving(spark, ["b > 150", "b % 100 = 50"], "b", _parts(5, 100)) == {200, 300, 400}
    assert surviving(spark, ["b > 5000"], "b", _parts(5, 100)) == set()
