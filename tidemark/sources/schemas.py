"""Explicit schemas of the raw files. Nothing is inferred: identifiers look numeric and phones start with 0.

A trailing ``!`` in the text form marks a column that must not be NULL (enforced by the required-columns check).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, order and types of the raw files.
RAW = {
    "raw_events": "event_date string!, event_timestamp bigint!, event_name string!, user_pseudo_id string!, ga_session_id bigint, "
                  "customer_id string, utm_source string, utm_medium string, utm_campaign string, creative_id string, "
                  "promotion_id string, item_id string, item_variant string, quantity bigint, value double, "
                  "transaction_id string, data_source string",
    "raw_orders": "transaction_id string!, order_ts timestamp!, order_date date!, customer_id string, user_pseudo_id string, "
                  "item_id string, item_variant string, quantity bigint, unit_price bigint, revenue bigint, utm_source string, "
                  "utm_medium string, utm_campaign string, payment_status string",
    "raw_ad_daily": "date date!, creative_id string!, ad_group_id string, channel string, utm_campaign string, impressions bigint, "
                    "clicks bigint, cost decimal(18,2)",
    "raw_creatives": "creative_id string!, channel string, utm_campaign string, promotion_id string, ad_group_id string, "
                     "audience string, format string, start_date date, end_date date, product_focus string, has_person boolean, "
                     "cta_position string, dominant_color string, text_density string, image_file string",
    "raw_customers": "customer_id string!, name string, email string, phone string, city string, first_order_date date",
}

NESTED_EXPORT = (
    "event_date string, event_timestamp bigint, event_name string, user_pseudo_id string, user_id string, "
    "event_params array<struct<key:string,value:struct<string_value:string,int_value:bigint,double_value:double,float_value:double>>>, "
    "items array<struct<item_id:string,item_variant:string,quantity:bigint>>, "
    "ecommerce struct<transaction_id:string,purchase_revenue:double>, "
    "collected_traffic_source struct<manual_source:string,manual_medium:string,manual_campaign_name:string>")


def schema_of(text: str) -> T.StructType:
    plain = T._parse_datatype_string(text.replace("!", ""))
    required = {part.split()[0] for part in text.split(", ") if part.rstrip().endswith("!")}
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in required) for f in plain.fields])


def raw_schema(name: str) -> T.StructType:
    return schema_of(RAW[name])


def required_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not f.nullable]
