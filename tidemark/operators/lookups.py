"""Parameterised reads. Column names come from fixed lists, values are literals, never text pasted into SQL."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import count_rows, ratio
from .text_safety import mask_pii

MAX_ROWS = 20
MAX_CUSTOMERS = 5
SPEND_GROUPS = {"channel": "channel", "ad_group": "ad_group_id", "creative": "creative_id", "campaign": "utm_campaign"}


def _period(start: date, end: date) -> None:
    if start is None or end is None:
        raise ValueError("start and end are required")
    if start > end:
        raise ValueError("start after end")


def ad_spend(ads: DataFrame, start: date, end: date, group_by: str, channel: str = "all", channels: Sequence[str] = (), max_rows: int = MAX_ROWS) -> DataFrame:
    """U-07: spend per group, largest first; every row tells how many groups there are and whether the list is cut (the report's size is its feature)."""
    if group_by not in SPEND_GROUPS:
        raise ValueError(f"group_by must be one of {sorted(SPEND_GROUPS)}")
    if channels and channel != "all" and channel not in channels:
        raise ValueError(f"unknown channel {channel}")
    _period(start, end)
    column = SPEND_GROUPS[group_by]
    inside = ads.where(F.col("date").between(F.lit(start), F.lit(end)))
    if channel != "all":
        inside = inside.where(F.col("channel") == channel)
    extra = [] if group_by == "channel" else [F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channel")]
    per = inside.groupBy(F.col(column).alias(group_by)).agg(
        *extra, F.round(F.sum("cost")).cast("bigint").alias("cost_twd"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"),
        F.round(ratio(F.sum("clicks"), F.sum("impressions")), 4).alias("ctr"), F.round(ratio(F.sum("cost"), F.sum("clicks")), 2).alias("cpc_twd"), F.count_distinct("date").alias("days_with_data"))
    total = inside.agg(F.count_distinct(column)).scalar()
    return per.orderBy(F.desc("cost_twd"), group_by).limit(max_rows).withColumns({"total_groups": total, "truncated": total > max_rows})


def top_customers(orders: DataFrame, customers: DataFrame, start: date, end: date, n: int = MAX_CUSTOMERS, mask: bool = True, paid: Column | None = None) -> DataFrame:
    """U-08: highest revenue in a period. Only the few winners are joined with the personal data, which is masked unless the caller is code."""
    _period(start, end)
    used = orders.where(F.col("order_date").between(F.lit(start), F.lit(end)))
    used = used if paid is None else used.where(paid)
    # without a customer row there is nobody to list
    top = used.join(customers.select("customer_id"), "customer_id", "left_semi").groupBy("customer_id").agg(
        F.count_distinct("transaction_id").alias("orders"), F.sum("revenue").alias("revenue_twd")).orderBy(F.desc("revenue_twd"), "customer_id").limit(n)
    out = top.join(customers.select("customer_id", "name", "email", "phone", "city"), "customer_id")
    return (mask_pii(out, "name", "email", "phone") if mask else out).orderBy(F.desc("revenue_twd"), "customer_id")


def campaign_notes(notes: DataFrame, campaign: str = "all", campaigns: Sequence[str] = (), limit: int = 300) -> DataFrame:
    """U-09: notes of a campaign, trimmed to the length a reader is shown."""
    if campaigns and campaign != "all" and campaign not in campaigns:
        raise ValueError(f"unknown campaign {campaign}")
    used = notes if campaign == "all" else notes.where(F.col("utm_campaign") == campaign)
    return used.select(F.col("utm_campaign").alias("campaign"), "author", "updated_date", F.substring("note", 1, limit).alias("note")).orderBy("campaign", "updated_date")
