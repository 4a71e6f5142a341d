"""Customer segmentation: behaviour features, scaled k-means, and how clusters compare with known customer types."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import count_rows, ratio

CATEGORIES = ("sock", "bath", "face", "set")


def segment_features(orders: DataFrame, category: Column, categories: Sequence[str] = CATEGORIES, paid: Column | None = None, observed_days: int = 30) -> DataFrame:
    """G-01: one row per customer.

    Everything is one aggregate per customer with map-side combine. The first order is an arg-min, and the mean gap between
    consecutive orders is the span from first to last order divided by the number of gaps, so no per-customer sort is needed.
    """
    own = orders.where("data_source = 'synthetic'")
    as_of = own.agg(F.max("order_date")).scalar()
    used = (own if paid is None else own.where(paid)).withColumn("_cat", category)
    order = F.struct("order_us", "transaction_id")
    qty = F.sum("quantity")
    share = {f"share_{c}": ratio(F.sum(F.when(F.col("_cat") == c, F.coalesce("quantity", F.lit(0))).otherwise(0)), qty) for c in categories}
    per = used.groupBy("customer_id").agg(
        F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"), count_rows().alias("order_count"),
        qty.alias("total_qty"), F.sum("revenue").alias("total_revenue"), F.min_by(F.struct("quantity", "_cat", "order_date"), order).alias("f"),
        F.max_by("order_date", order).alias("l"), *[v.alias(k) for k, v in share.items()])
    days = F.datediff(as_of, "first_order_date")
    gap = F.try_divide(F.datediff("l", F.col("f.order_date")).cast("double"), (F.col("order_count") - 1).cast("double"))
    return per.select(
        "customer_id", "first_order_date", F.col("f._cat").alias("first_category"), days.alias("observed_days"), (days >= observed_days).alias("observed_30d"),
        "order_count", "total_qty", "total_revenue", F.col("f.quantity").alias("first_qty"), *share,
        F.coalesce(gap, days.cast("double")).alias("avg_gap_days"), F.datediff(as_of, "last_order_date").alias("recency_days"))


def features_summary(features: DataFrame) -> DataFrame:
    return features.agg(count_rows().alias("customers"), F.count_if("observed_30d").alias("observed_30d"), F.round(F.avg("order_count"), 3).alias("avg_orders"),
                        F.count_if(F.col("first_qty").isNull() | F.col([c for c in features.columns if c.startswith("share_")][0]).isNull()).alias("null_rows"))


def feature_names(features: DataFrame) -> list[str]:
    shares = [c for c in features.columns if c.startswith("share_")]
    return ["order_count", "total_qty", "total_revenue", "first_qty", *shares, "avg_gap_days", "recency_days"]


@dataclass(frozen=True)
class SegmentModel:
    """Scaling and centres of a fitted segmentation; everything that assignment needs, k x features numbers."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]  # 0 where a feature never varies
    centers: tuple[tuple[float, ...], ...]

    def scaled(self) -> Column:
        """Standardised features as an array; a missing value counts as the mean."""
        return F.array(*[F.coalesce((F.col(n).cast("double") - m) * v, F.lit(0.0)) for n, m, v in zip(self.names, self.means, self.scales)])

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as a relation: one row per centre and feature."""
        rows = [(i + 1, j + 1, n, self.means[j], self.scales[j], c[j]) for i, c in enumerate(self.centers) for j, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "centroid_id int, position int, feature string, mean double, scale double, center double")

    @classmethod
    def from_table(cls, table: DataFrame) -> SegmentModel:
        rows = table.orderBy("centroid_id", "position").collect()
        first = [r for r in rows if r.centroid_id == 1]
        centers = tuple(tuple(r.center for r in rows if r.centroid_id == i) for i in sorted({r.centroid_id for r in rows}))
        return cls(tuple(r.feature for r in first), tuple(r.mean for r in first), tuple(r.scale for r in first), centers)


def _squared(v: str, center: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(v)[j] - x) * (F.col(v)[j] - x) for j, x in enumerate(center)])


def _nearest(points: DataFrame, centers: Sequence[Sequence[float]], v: str = "_v") -> DataFrame:
    """``_c`` (from 1; of equally near centres the first) and ``_d2``, the squared distance to it."""
    every = points.withColumn("_all", F.array(*[_squared(v, c) for c in centers])).withColumn("_d2", F.array_min("_all"))
    return every.withColumn("_c", F.array_position("_all", F.col("_d2")).cast("int")).drop("_all")


def _measure(centers: Sequence[Sequence[float]]) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
    """Function to the points of a batch and their squared distances to every centre, summed in the order ``_squared`` sums them.

    Centres are data of the tasks: written into expressions, every new set of them would be compiled anew.
    """
    c = np.array(centers, float)

    def distances(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
        every = np.zeros((len(c), len(v)))
        for j in range(c.shape[1]):
            every += (v[:, j] - c[:, j, None]) ** 2
        return v, every
    return distances


def _with_distance(points: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """``_d2``, the squared distance to the nearest centre."""
    distances = _measure(centers)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.fmin.reduce(distances(b)[1]))], [*b.schema.names, "_d2"])

    return points.mapInArrow(work, points.withColumn("_d2", F.lit(0.0)).schema)


def _sums(points: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """(_c, n, s): number and sums of the points nearest to each centre that has any; each task adds up its own points first."""
    distances, k, p = _measure(centers), len(centers), len(centers[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, p))
        for b in batches:
            v, every = distances(b)
            near = np.argmin(np.where(np.isnan(every), np.inf, every), axis=0)  # of equally near centres the first
            n += np.bincount(near, minlength=k)
            for j in range(p):
                total[:, j] += np.bincount(near, v[:, j], k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used + 1, pa.int32()), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["_c", "n", "s"])

    parts = points.select("_v").mapInArrow(work, "_c int, n long, s array<double>")
    return parts.groupBy("_c").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(p)]).alias("s"))


def _race(seed: int, step: int) -> Column:
    """Exponential number of a customer and step, the same on every machine and in every partitioning."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit(step), F.col("customer_id")).cast("binary")), 1, 13)
    return -F.log((F.conv(digits, 16, 10).cast("double") + 1) / (16.0**13 + 1))


def fit_segments(features: DataFrame, k: int = 4, seed: int = 11, observed_only: bool = True, names: Sequence[str] | None = None, rounds: int = 20) -> SegmentModel:
    """G-02: k-means on standardised features, started by k-means++.

    A starting centre is drawn in proportion to the squared distance from those already drawn. Each draw is a race: every customer has an
    exponential number, hashed from seed, step and id, divided by its squared distance, and the smallest wins; that is one aggregate
    per centre, and neither partitioning nor row order has a say. Every round of Lloyd's algorithm is one aggregate into k rows. Fewer
    different customers than ``k`` give fewer centres; a centre that loses all customers stays where it is. ``features`` are read once per round:
    hand in a written table.
    """
    names = tuple(names or feature_names(features))
    train = features.where("observed_30d") if observed_only else features
    double = [F.col(n).cast("double") for n in names]
    stats = train.agg(*[F.avg(c) for c in double], *[F.stddev_samp(c) for c in double]).first()
    means = tuple(m or 0.0 for m in stats[:len(names)])
    scales = tuple(1 / v if v else 0.0 for v in stats[len(names):])
    base = SegmentModel(names, means, scales, ())
    points = train.select("customer_id", base.scaled().alias("_v"))
    centers: list[tuple[float, ...]] = []
    for step in range(k):
        at = _with_distance(points, centers).where("_d2 > 0") if centers else points.withColumn("_d2", F.lit(1.0))
        drawn = at.agg(F.min_by("_v", F.struct(_race(seed, step) / F.col("_d2"), "customer_id"))).first()[0]
        if drawn is None:
            break
        centers.append(tuple(drawn))
    for _ in range(rounds if centers else 0):
        moved = list(centers)
        for row in _sums(points, centers).collect():
            moved[row["_c"] - 1] = tuple(x / row["n"] for x in row["s"])
        still = max(abs(a - b) for old, new in zip(centers, moved) for a, b in zip(old, new)) < 1e-12
        centers = moved
        if still:
            break
    return SegmentModel(names, means, scales, tuple(centers))


def assign_segments(model: SegmentModel, features: DataFrame) -> DataFrame:
    """G-03: nearest centroid (numbered from 1) and its distance for all customers; both NULL if the model has no centre."""
    if not model.centers:
        return features.select("customer_id", "observed_30d", F.lit(None).cast("int").alias("centroid_id"), F.lit(None).cast("double").alias("distance"))
    near = _nearest(features.withColumn("_v", model.scaled()), model.centers)
    return near.select("customer_id", "observed_30d", F.col("_c").alias("centroid_id"), F.sqrt("_d2").alias("distance"))


def assignment_certificate(model: DataFrame, features: DataFrame, segments: DataFrame) -> DataFrame:
    """Counts that must be 0 for a right assignment, from the saved model table and features alone, centre by centre in rows.

    ``unlisted``: a segment that the model does not have; ``not_nearest``: another centre is nearer by more than rounding; ``wrong_distance``.
    """
    long = features.select("customer_id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in feature_names(features)])))
    part = F.pow(F.coalesce((F.col("x") - F.col("mean")) * F.col("scale"), F.lit(0.0)) - F.col("center"), 2)
    apart = long.join(F.broadcast(model), "feature").groupBy("customer_id", "centroid_id").agg(F.sqrt(F.sum(part)).alias("d"))
    judged = segments.join(apart.withColumnRenamed("centroid_id", "other"), "customer_id").groupBy("customer_id").agg(
        F.first("centroid_id").alias("c"), F.first("distance").alias("own"), F.min("d").alias("least"), F.max(F.when(F.col("other") == F.col("centroid_id"), F.col("d"))).alias("listed"))
    return judged.agg(count_rows().alias("customers"), F.count_if(F.col("listed").isNull()).alias("unlisted"), F.count_if(F.col("listed") > F.col("least") + 1e-9).alias("not_nearest"),
                      F.count_if(F.abs(F.col("listed") - F.col("own")) > 1e-6).alias("wrong_distance"))


def cluster_profile(segments: DataFrame, features: DataFrame) -> DataFrame:
    """G-04."""
    f = features.drop("observed_30d")
    shares = [c for c in f.columns if c.startswith("share_")]
    mean = lambda c, n: F.round(F.avg(c), n)
    return segments.where("observed_30d").select("customer_id", "centroid_id").join(f, "customer_id").groupBy("centroid_id").agg(
        count_rows().alias("customers"), mean("order_count", 2).alias("avg_orders"), F.round(ratio(F.count_if(F.col("order_count") > 1), count_rows()), 3).alias("repeat_rate"),
        mean("first_qty", 2).alias("avg_first_qty"), F.round(F.avg(F.col("total_revenue").cast("double"))).alias("avg_revenue"),
        *[mean(s, 2).alias(s) for s in shares], mean("avg_gap_days", 0).alias("avg_gap_days"), mean("recency_days", 0).alias("recency_days"))


def centroids_long(model: SegmentModel, like: DataFrame) -> DataFrame:
    """G-05: centroid x feature with its standardised value (k x features rows, from the fitted model)."""
    rows = [(i + 1, n, round(v, 2)) for i, c in enumerate(model.centers) for n, v in zip(model.names, c)]
    return like.sparkSession.createDataFrame(rows, "centroid_id int, feature string, value double")


def davies_bouldin(models: Mapping[str, SegmentModel], features: DataFrame) -> DataFrame:
    """G-06: mean over clusters of the worst (spread_i + spread_j) / centroid distance; smaller is tighter."""
    spark, out = features.sparkSession, []
    for name, m in models.items():
        base = features if name.endswith("_all") else features.where("observed_30d")
        spread = assign_segments(m, base).groupBy("centroid_id").agg(F.avg("distance").alias("s"))
        c = m.centers
        gaps = [(i + 1, j + 1, sum((a - b) ** 2 for a, b in zip(c[i], c[j])) ** 0.5) for i in range(len(c)) for j in range(len(c)) if i != j]
        pairs = spark.createDataFrame(gaps, "i int, j int, gap double")
        si, sj = spread.toDF("i", "si"), spread.toDF("j", "sj")
        worst = pairs.join(si, "i").join(sj, "j").groupBy("i").agg(F.max((F.col("si") + F.col("sj")) / F.col("gap")).alias("r"))
        out.append(worst.agg(F.lit(name).alias("model_name"), F.lit(len(c)).alias("k"), F.avg("r").alias("davies_bouldin_index")))
    return union_all(out).orderBy("model_name")


def cluster_vs_truth(segments: DataFrame, truth: DataFrame, types: Sequence[str], by: Sequence[str] = ("observed_30d", "centroid_id")) -> DataFrame:
    """G-07: customers of each true type per cluster and observation cohort (or model)."""
    return segments.join(truth, "customer_id").groupBy(*by).agg(count_rows().alias("customers"), *[F.count_if(F.col("segment") == t).alias(t) for t in types])


def check_segmentation(features: DataFrame, segments: DataFrame, truth: DataFrame, customers: object, observed: object, k: int, wanted: Mapping[str, float]) -> DataFrame:
    """G-08: counts, nulls, number of clusters, and how much of a true type sits in one cluster."""
    c = F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(n) for n, x in a.items()])).scalar()
    share = [x for x in features.columns if x.startswith("share_")][0]
    nulls = c("first_qty").isNull() | c(share).isNull() | c("avg_gap_days").isNull() | c("recency_days").isNull()
    j = segments.where("observed_30d").join(truth, "customer_id").groupBy("segment", "centroid_id").agg(count_rows().alias("n"))
    top = j.groupBy("segment").agg(F.round(ratio(F.max("n"), F.sum("n")), 3).alias("top"))
    pick = {f"t{i}": top.where(c("segment") == t).agg(F.max("top")).scalar() for i, t in enumerate(wanted)}
    facts = one_row(features.sparkSession, f=struct(features, n=count_rows(), n30=F.count_if("observed_30d"), nulls=F.count_if(nulls)),
                    m=struct(segments, n=count_rows(), k=F.count_distinct("centroid_id")), **pick)
    return check_rows(facts, [
        ("1 seg_features rows", str(customers), c("f.n")), ("2 observed_30d", str(observed), c("f.n30")), ("3 feature nulls", "0", c("f.nulls")),
        ("4 mart rows", str(customers), c("m.n")), ("5 clusters", str(k), c("m.k")),
        *[(f"{6 + i} {t} in one cluster", f">={w}", c(f"t{i}"), c(f"t{i}") >= w) for i, (t, w) in enumerate(wanted.items())]])
