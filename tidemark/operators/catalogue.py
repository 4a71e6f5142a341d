"""R-23: what an advertisement may and may not say, as versioned relations, and texts matched against them.

A catalogue is a table (version, term, kind): terms are rows, so a word list can grow, and several versions are matched in one pass. A text and
a term meet on an anchor, the first two characters of the normalised term, and only such pairs are tested for containment; neither all pairs nor
one expression per term is formed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.exprs import count_rows

ANCHOR = 2


def claim_catalogue(spark: SparkSession, versions: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """version, term, kind; one row per term and version."""
    rows = [(v, term, kind) for v, terms in versions.items() for term, kind in terms]
    return spark.createDataFrame(rows, "version string, term string, kind string")


def product_facts(products: DataFrame, item: str, fields: Sequence[str], version: Column) -> DataFrame:
    """version, item_id, field, value: what a draft may say about an item, one row per fact that is known."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return products.select(version.alias("version"), F.col(item).alias("item_id"), F.inline(pairs)).where("value IS NOT NULL").distinct()


def facts_as_of(facts: DataFrame, version: object) -> DataFrame:
    """Per item and field the value of the newest version up to this one; of several in one version the first in order."""
    upto = facts.where(F.col("version") <= F.lit(version))
    return upto.groupBy("item_id", "field").agg(F.max("version").alias("version"), F.min_by("value", F.struct(-F.col("version"), "value")).alias("value"))


def catalogue_hits(texts: DataFrame, keys: Sequence[str], column: Column, catalogue: DataFrame) -> DataFrame:
    """keys, version, term, kind: every term of every version that stands in the normalised text, once per text."""
    said = texts.select(*keys, tx.normalize(column).alias("_norm")).where(F.length("_norm") > 0)
    known = catalogue.distinct().withColumn("_term", tx.normalize(F.col("term"))).where(F.length("_term") > 0).withColumn("_anchor", F.substring("_term", 1, ANCHOR))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("_norm")), lambda i: F.substr(F.col("_norm"), i, F.lit(n)))
    grams = F.array_distinct(F.concat(*[at(n) for n in range(1, ANCHOR + 1)]))
    met = said.select(*keys, F.explode(grams).alias("_anchor")).join(known, "_anchor").drop("_anchor")
    return met.join(said, list(keys)).where(F.contains("_norm", "_term")).select(*keys, "version", "term", "kind").distinct()


def hits_per_version(texts: DataFrame, keys: Sequence[str], by: str, column: Column, catalogue: DataFrame) -> DataFrame:
    """R-26 on a catalogue: flagged texts, hits and different terms per catalogue version and ``by``."""
    hits = catalogue_hits(texts, keys, column, catalogue).withColumnRenamed("version", "lexicon").join(texts.select(*keys, by), list(keys))
    return hits.groupBy(by, "lexicon").agg(F.count_distinct(*keys).alias("flagged"), count_rows().alias("hits"), F.count_distinct("term").alias("terms"))
