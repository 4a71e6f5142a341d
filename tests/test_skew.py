"""The sliced form of the ordered computations must equal the plain one, also when one key holds most rows."""

import random

from pyspark.sql import functions as F

from tidemark.functions.skew import keyed_sequence, order_slices


def _rows(n=600, seed=3):
    r = random.Random(seed)
    # two thirds of the rows belong to one key, times repeat
    return [(i, "hot" if r.random() < 0.67 else f"k{r.randrange(8)}", r.randrange(200), r.randrange(5)) for i in range(n)]


def test_sliced_equals_plain(spark):
    df = spark.createDataFrame(_rows(), "id int, k string, t bigint, v bigint")
    args = dict(row_number="rn", lag={"before": "t"}, running={"run": F.col("v")}, totals={"total": F.col("v"), "n": F.lit(1).cast("bigint")})
    cuts = order_slices(df, "t", 7)
    plain = keyed_sequence(df, ["k"], ["t", "id"], **args)
    sliced = keyed_sequence(df, ["k"], ["t", "id"], cuts=cuts, slice_on="t", **args).select(*plain.columns)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sliced.collect()))


def test_slices_bound_the_hot_key(spark):
    from tidemark.functions.skew import with_slice
    df = spark.createDataFrame([(i, "hot", i) for i in range(1000)], "id int, k string, t bigint")
    sliced = with_slice(df, "t", order_slices(df, "t", 10))
    assert max(r["count"] for r in sliced.groupBy("k", "_slice").count().collect()) <= 150


def test_null_lag_and_first_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "b", 9)], "id int, k string, t bigint")
    out = keyed_sequence(df, ["k"], ["t"], cuts=[3.0], slice_on="t", row_number="rn", lag={"p": "t"})
    assert {r.id: (r.rn, r.p) for r in out.collect()} == {1: (1, None), 2: (2, 1), 3: (1, None)}


def test_salted_join_equals_plain_join(spark):
    from tidemark.functions.skew import salted_join
    left = spark.createDataFrame(_rows(), "id int, k string, t bigint, v bigint")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k9", 3)], "k string, x int")
    a, b = left.join(right, "k").orderBy("id").collect(), salted_join(left, right, ["k"]).orderBy("id").collect()
    assert [tuple(r[c] for c in ("id", "k", "t", "v", "x")) for r in a] == [tuple(r[c] for c in ("id", "k", "t", "v", "x")) for r in b]


def test_slices_are_found_by_binary_search(spark):
    import bisect
    from tidemark.functions.skew import with_slice
    r = random.Random(8)
    df = spark.createDataFrame([(i, None if i == 0 else r.randrange(-5, 400)) for i in range(500)], "id int, t bigint")
    for n in (0, 1, 2, 7, 8, 255, 1000):
        points = sorted(r.choice([r.randrange(400), r.random() * 400]) for _ in range(n))
        got = with_slice(df, "t", points).collect()
        assert all(x._slice == (0 if x.t is None else bisect.bisect_right(points, x.t)) for x in got)
    many = with_slice(df, "t", order_slices(df, "t", 1000))
    want = sorted(x for (x,) in df.where("t IS NOT NULL").select("t").collect())
    cut = [want[max(0, -(-len(want) * i // 1000) - 1)] for i in range(1, 1000)]
    assert all(x._slice == (0 if x.t is None else bisect.bisect_right(cut, x.t)) for x in many.collect())
    plan = many._jdf.queryExecution().executedPlan().toString()
    # one subquery, looked up ten times inside generated code; no copy of the cut points per row
    assert "Generate" not in plan and "lambda" not in plan and many.columns == ["id", "t", "_slice"]


def test_slices_of_an_empty_table(spark):
    from tidemark.functions.skew import with_slice
    df = spark.createDataFrame([], "id int, t bigint")
    assert with_slice(df, "t", order_slices(df, "t", 9)).count() == 0
    one = spark.createDataFrame([(1, 5)], "id int, t bigint")
    assert [x._slice for x in with_slice(one, "t", order_slices(df, "t", 9)).collect()] == [0]
