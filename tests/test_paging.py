import hashlib

from tidemark.functions.paging import list_pages, page_text


def test_pages_hold_every_item_once(spark):
    rows = [("hot" if i % 2 else f"k{i % 6}", f"c{i}" if i % 50 else None) for i in range(900)] + [("hot", "c1"), (None, "x")]
    df = spark.createDataFrame(rows, "k string, item string")
    pages = list_pages(df, ["k"], "item", 40, slices=7)
    got = {}
    for r in pages.collect():
        got.setdefault(r.k, []).append((r.position, r.page, r.item))
    for k, items in got.items():
        mine = sorted((x for key, x in rows if key == k and x is not None), key=lambda x: (int(hashlib.md5(x.encode()).hexdigest()[:15], 16), x))
        assert sorted(items) == [(n + 1, n // 40 + 1, x) for n, x in enumerate(mine)]
    second = {r.k: r["items"] for r in page_text(pages, ["k"], "item", 2).collect()}
    assert second["hot"] == "、".join(sorted(x for _, p, x in got["hot"] if p == 2)) and None not in second


def test_a_hot_list_is_numbered_in_parts(spark):
    from tidemark.functions.checks import row_hash
    from tidemark.functions.paging import HASHES
    from tidemark.functions.skew import with_slice
    df = spark.range(4000).selectExpr("'hot' AS k", "cast(id AS string) AS item").withColumn("_h", row_hash(["item"]).cast("bigint"))
    sizes = [r["count"] for r in with_slice(df, "_h", [HASHES * i // 16 for i in range(1, 16)]).groupBy("k", "_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 4000 / 16


def test_pages_of_nothing(spark):
    df = spark.createDataFrame([], "k string, item string")
    assert list_pages(df, ["k"], "item").count() == 0 and list_pages(df, [], "item").count() == 0
