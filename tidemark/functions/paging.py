"""Long lists as numbered rows instead of one value.

Every item of a key gets a position and a page. The order is that of a hash of the item, cut into ranges of equal width, so a key that holds half of
all items is numbered by as many tasks as there are ranges, with one small count per key and range (see ``keyed_sequence``). Text is made only for
the page that is asked for, at most ``size`` items per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .checks import row_hash
from .skew import keyed_sequence, slice_count

PAGE = 1000
HASHES = 1 << 60


def list_pages(df: DataFrame, keys: Sequence[str], item: str, size: int = PAGE, slices: int | None = None) -> DataFrame:
    """``keys``, ``item``, ``position`` (from 1) and ``page`` (from 1) of every item that is not NULL; repeated items are numbered each."""
    slices = slices or slice_count(df)
    cuts = [HASHES * i // slices for i in range(1, slices)]
    rows = df.where(F.col(item).isNotNull()).select(*keys, item).withColumn("_h", row_hash([item]).cast("bigint"))
    numbered = keyed_sequence(rows, keys, ["_h", item], cuts=cuts, slice_on="_h", row_number="position")
    return numbered.drop("_h").withColumn("page", F.expr(f"(position - 1) div {int(size)} + 1").cast("int"))


def page_text(pages: DataFrame, keys: Sequence[str], item: str, page: int = 1, separator: str = "、", name: str = "items") -> DataFrame:
    """``keys`` and the items of one page as text, in their own order; the list that is gathered is no longer than a page."""
    one = pages.where(F.col("page") == page).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(name))
    return one.withColumn(name, F.array_join(name, separator))
