"""Customer value: first-order features, 30-day follow-up revenue, chronological split, linear regression and its baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.checks import check_rows, one_row, union_all
from ..functions.exprs import count_rows, money, oldest, ratio

FIRST = {"order_date": "first_order_date", "item_id": "first_item_id", "quantity": "first_qty", "revenue": "first_revenue", "utm_source": "first_source",
         "utm_medium": "first_medium", "utm_campaign": "first_campaign"}


def first_order_features(orders: DataFrame, paid: Column | None = None) -> DataFrame:
    """L-01: item, amount and source of each customer's first order (ties by id)."""
    used = orders.where("data_source = 'synthetic'")
    used = used if paid is None else used.where(paid)
    first = used.groupBy("customer_id").agg(oldest([*FIRST, "transaction_id"], "order_us", "transaction_id").alias("f"))
    return first.select("customer_id", F.col("f.transaction_id").alias("first_transaction_id"), *[F.col(f"f.{k}").alias(v) for k, v in FIRST.items()])


def future_revenue(orders: DataFrame, paid: Column | None = None, days: int = 30) -> DataFrame:
    """L-02: revenue of later orders up to 30 days after the first one, and whether 30 days have been observed."""
    own = orders.where("data_source = 'synthetic'")
    as_of = own.agg(F.max("order_date")).scalar()
    used = own if paid is None else own.where(paid)
    first = first_order_features(orders, paid)
    # revenue per customer and day is combined before the shuffle, so a customer with very many orders is no burden; the first order
    # itself is always inside the window and is taken off again
    per_day = used.groupBy("customer_id", "order_date").agg(F.sum("revenue").alias("day_revenue"))
    window = per_day.join(first.select("customer_id", "first_order_date"), "customer_id").where(F.col("order_date") <= F.date_add("first_order_date", days)) \
        .groupBy("customer_id").agg(F.sum("day_revenue").alias("all_revenue"))
    later = window.join(first.select("customer_id", "first_revenue"), "customer_id").select(
        "customer_id", (F.coalesce("all_revenue", F.lit(0)) - F.coalesce("first_revenue", F.lit(0))).alias("r"))
    return first.join(later, "customer_id", "left").select(
        *[c for c in first.columns if c != "first_transaction_id"], (F.datediff(as_of, "first_order_date") >= days).alias("label_complete"),
        F.coalesce("r", F.lit(0)).cast("decimal(18,2)").alias("future_revenue_30d"))


def chronological_split(labeled: DataFrame, train_share: float = 0.8) -> DataFrame:
    """L-03: the latest part of the customers with complete labels is kept for evaluation; one day is never split.

    The percent rank of a date is the share of customers with an earlier date, so a running sum over customers per day (one row per
    calendar day) replaces a global sort of all customers.
    """
    w = Window.orderBy("first_order_date").rowsBetween(Window.unboundedPreceding, -1)
    per_day = labeled.where("label_complete").groupBy("first_order_date").agg(count_rows().alias("n"))
    total = labeled.agg(F.count_if("label_complete")).scalar()
    rank = per_day.select(F.col("first_order_date").alias("_d"), F.coalesce(ratio(F.coalesce(F.sum("n").over(w), F.lit(0)), total - 1), F.lit(0.0)).alias("_pr"))
    joined = labeled.join(rank, labeled.first_order_date == rank["_d"], "left")
    return joined.withColumn("is_eval", F.when(F.col("label_complete"), F.col("_pr") > train_share)).drop("_d", "_pr")


CATEGORICAL = ("first_item_id", "first_source", "first_medium")
NUMERIC = ("first_qty", "first_revenue")
RIDGE = 1e-4
LEVEL_ROWS = 5


def fit_ltv(features: DataFrame, with_campaign: bool = False) -> PipelineModel:
    """L-04: one-hot encoded categories and amounts, least squares on the training part; unseen categories get no effect.

    The normal equations are solved as a whole. ``RIDGE``, on the scale of standardised inputs and label, makes them regular although the categories of one
    column add up to 1; it also keeps the solution the same in every partitioning, up to rounding.
    """
    cats = [*CATEGORICAL, *(["first_campaign"] if with_campaign else [])]
    train = _model_input(features).where("label_complete and not is_eval")
    # the solver divides its parameter by the deviation of the label
    scale = train.agg(F.stddev_pop("label")).first()[0] or 1.0
    stages = [
        StringIndexer(inputCols=[f"{c}_k" for c in cats], outputCols=[f"{c}_i" for c in cats], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in cats], outputCols=[f"{c}_v" for c in cats], handleInvalid="keep"),
        Imputer(inputCols=[f"{c}_d" for c in NUMERIC], outputCols=[f"{c}_x" for c in NUMERIC]),
        VectorAssembler(inputCols=[*[f"{c}_v" for c in cats], *[f"{c}_x" for c in NUMERIC]], outputCol="x"),
        LinearRegression(featuresCol="x", labelCol="label", predictionCol="predicted", solver="normal", regParam=RIDGE * scale),
    ]
    return Pipeline(stages=stages).fit(train)


def _model_input(features: DataFrame) -> DataFrame:
    return features.withColumns({"label": F.col("future_revenue_30d").cast("double"), **{f"{c}_d": F.col(c).cast("double") for c in NUMERIC},
                                 **{f"{c}_k": F.coalesce(c, F.lit("(none)")) for c in (*CATEGORICAL, "first_campaign")}})


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(_model_input(features)).select(*features.columns, "predicted")


def regression_certificate(predicted: DataFrame, cats: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Correlation of the training residuals with each input, which least squares makes 0 but for ``RIDGE``, and their mean.

    One row per amount, and per category with at least ``LEVEL_ROWS`` training rows; computed from the saved predictions alone.
    """
    train = _model_input(predicted).where("label_complete and not is_eval").withColumn("r", F.col("label") - F.col("predicted"))
    whole = train.agg(F.struct(count_rows().alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev"))).scalar()
    tied = lambda x: F.round(F.abs(x), 2) < 0.01
    amounts = train.agg(F.array(*[F.struct(F.lit(c).alias("input"), F.corr(F.coalesce(F.col(f"{c}_d"), F.lit(0.0)), F.col("r")).alias("corr")) for c in NUMERIC]).alias("a")).select(F.inline("a"))
    level = F.explode(F.array(*[F.concat_ws("=", F.lit(c), F.col(f"{c}_k")) for c in cats])).alias("input")
    share = F.col("n") / F.col("w.n")
    levels = train.select(level, "r").groupBy("input").agg(count_rows().alias("n"), F.sum("r").alias("s")).withColumn("w", whole).where(F.col("n").between(LEVEL_ROWS, F.col("w.n") - LEVEL_ROWS))
    corr = (F.col("s") / F.col("w.n") - share * F.col("w.mean")) / F.sqrt(share * (1 - share)) / F.col("w.dev")
    return union_all([amounts, levels.select("input", corr.alias("corr"))]).select("input", tied(F.col("corr")).alias("orthogonal"))


def regression_metrics(predicted: DataFrame) -> DataFrame:
    """L-05: on the evaluation part; the median is a mergeable sketch."""
    y, p = F.col("future_revenue_30d").cast("double"), F.col("predicted")
    e = predicted.where("is_eval").select(y.alias("y"), p.alias("p"))
    err = F.abs(F.col("y") - F.col("p"))
    sq = F.pow(F.col("y") - F.col("p"), 2)
    return e.agg(F.avg(err).alias("mean_absolute_error"), F.sqrt(F.avg(sq)).alias("rmse"), F.percentile_approx(err, 0.5, 100_000).alias("median_absolute_error"),
                 (1 - ratio(F.sum(sq), F.var_pop("y") * count_rows())).alias("r2_score"))


def baselines(features: DataFrame, predicted: DataFrame | None = None) -> DataFrame:
    """L-06: errors of the global mean, of the mean per first item (global where an item is new), and of the model."""
    train, ev = features.where("label_complete and not is_eval"), features.where("is_eval")
    y = F.col("future_revenue_30d").cast("double")
    global_mean = train.agg(F.avg(y)).scalar()
    item = train.groupBy("first_item_id").agg(F.avg(y).alias("item_mean"))
    actual = y.alias("actual")
    parts = [ev.select(F.lit("1 global mean").alias("method"), actual, global_mean.alias("pred")),
             ev.join(item, "first_item_id", "left").select(F.lit("2 mean of first item").alias("method"), actual, F.coalesce("item_mean", global_mean).alias("pred"))]
    if predicted is not None:
        parts.append(predicted.where("is_eval").select(F.lit("3 linear regression").alias("method"), actual, F.col("predicted").alias("pred")))
    e = F.col("actual") - F.col("pred")
    return union_all(parts).groupBy("method").agg(
        count_rows().alias("customers"), F.round(F.avg(F.abs(e)), 1).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 1).alias("rmse"),
        F.round(F.avg("pred"), 1).alias("avg_pred"), F.round(F.avg("actual"), 1).alias("avg_actual")).orderBy("method")


def predict_ltv(predicted: DataFrame) -> DataFrame:
    """L-07: evaluation and new customers with a prediction that is never negative."""
    return predicted.where("is_eval or not label_complete").select(
        "customer_id", "first_order_date", "first_item_id", "first_source", "first_medium", "first_campaign",
        F.when(F.col("label_complete"), "eval").otherwise("new").alias("scope"), F.round(F.greatest("predicted", F.lit(0.0)), 1).alias("predicted_revenue_30d"),
        F.when(F.col("label_complete"), F.col("future_revenue_30d")).alias("actual_revenue_30d"))


def _mean(c: str) -> Column:
    """Mean of amounts in cents or tenths: their sum is exact, so that the order of rows cannot decide how a tie is rounded."""
    return F.sum(money(c)).cast("double") / F.count(c)


def value_to_cost(ltv: DataFrame, features: DataFrame, ads: DataFrame, channel: Column, channels: Sequence[str], start: date, end: date) -> DataFrame:
    """L-08: new customers, spend, cost per customer and expected value per channel and campaign."""
    new = ltv.where("scope = 'new'").join(features.select("customer_id", "first_revenue"), "customer_id") \
        .select(channel.alias("channel"), F.col("first_campaign").alias("utm_campaign"), "first_revenue", "predicted_revenue_30d")
    per = new.where(F.col("channel").isin(list(channels))).groupBy("channel", "utm_campaign").agg(
        count_rows().alias("new_customers"), F.round(_mean("first_revenue")).alias("avg_first_order"),
        F.round(_mean("predicted_revenue_30d")).alias("avg_pred_30d"))
    spend = ads.where(F.col("date").between(F.lit(start), F.lit(end))).groupBy("channel", "utm_campaign").agg(F.sum("cost").cast("double").alias("cost"))
    each = F.col("cost") / F.col("new_customers")
    value = F.col("avg_first_order") + F.col("avg_pred_30d")
    return per.join(spend, ["channel", "utm_campaign"]).select(
        "channel", "utm_campaign", "new_customers", F.round("cost").alias("ad_cost"), F.round(each).alias("cost_per_new"), "avg_first_order", "avg_pred_30d",
        value.alias("expected_value_30d"), F.round(ratio(value, each), 2).alias("value_to_cost")).orderBy(F.desc("value_to_cost"))


def unseen_category_effect(with_campaign: DataFrame, without: DataFrame) -> DataFrame:
    """L-09: both models' mean prediction for new customers, per campaign and first item."""
    a = with_campaign.where("not label_complete").select("customer_id", "first_campaign", "first_item_id", F.col("predicted").alias("pa"))
    b = without.where("not label_complete").select("customer_id", F.col("predicted").alias("pb"))
    return a.join(b, "customer_id").groupBy("first_campaign", "first_item_id").agg(
        count_rows().alias("customers"), F.round(F.avg("pa")).alias("with_campaign"), F.round(F.avg("pb")).alias("without_campaign"))


def value_by_truth(ltv: DataFrame, truth: DataFrame) -> DataFrame:
    """L-10, first table."""
    a = F.col("actual_revenue_30d")
    return ltv.join(truth, "customer_id").groupBy("scope", "segment").agg(
        count_rows().alias("customers"), F.round(_mean("predicted_revenue_30d"), 1).alias("avg_pred"), F.round(_mean("actual_revenue_30d"), 1).alias("avg_actual"),
        F.round(ratio(F.count_if(a > 0), F.count(a)), 3).alias("repeat_rate"))


def value_by_item_and_truth(ltv: DataFrame, truth: DataFrame) -> DataFrame:
    return ltv.join(truth, "customer_id").groupBy("first_item_id", "segment").agg(
        count_rows().alias("customers"), F.round(_mean("predicted_revenue_30d"), 1).alias("avg_pred"))


def features_summary(features: DataFrame) -> DataFrame:
    """L-11, second half."""
    full, d = F.col("label_complete"), F.col("first_order_date")
    return features.agg(
        F.count_if(full).alias("labeled"), F.count_if("is_eval").alias("eval_rows"), F.count_if(~full).alias("to_predict"),
        F.max(F.when(~F.col("is_eval"), d)).alias("train_until"), F.min(F.when(F.col("is_eval"), d)).alias("eval_from"),
        F.round(F.avg(F.when(full, F.col("future_revenue_30d").cast("double"))), 1).alias("avg_label"),
        F.round(ratio(F.count_if(full & (F.col("future_revenue_30d") > 0)), F.count_if(full)), 3).alias("repeat_30d_rate"))


def check_ltv(features: DataFrame, ltv: DataFrame, predicted: DataFrame, truth: DataFrame, regular: str, wanted: Mapping[str, object]) -> DataFrame:
    """L-11, first half: nine checks."""
    c = F.col
    struct = lambda df, **a: df.agg(F.struct(*[x.alias(n) for n, x in a.items()])).scalar()
    d, p = c("first_order_date"), c("predicted_revenue_30d")
    y = c("future_revenue_30d").cast("double")
    mean = features.where("label_complete and not is_eval").agg(F.avg(y)).scalar()
    mine = c("segment") == regular
    facts = one_row(
        features.sparkSession,
        f=struct(features, n=count_rows(), labeled=F.count_if("label_complete"), ev=F.count_if("is_eval"), new=F.count_if(~c("label_complete")),
                 apart=F.max(F.when(~c("is_eval"), d)) < F.min(F.when(c("is_eval"), d))),
        m=struct(ltv, n=count_rows(), bad=F.count_if(p.isNull() | (p < 0))),
        g=features.where("is_eval").withColumn("_m", mean).agg(F.round(F.avg(F.abs(y - c("_m"))), 1)).scalar(),
        r=predicted.where("is_eval").agg(F.round(F.avg(F.abs(y - c("predicted"))), 1)).scalar(),
        s=ltv.where("scope = 'eval'").join(truth, "customer_id").agg(F.round(ratio(F.avg(F.when(mine, p)), F.avg(F.when(~mine, p))), 2)).scalar())
    w = lambda k: str(wanted[k])
    return check_rows(facts, [
        ("1 ltv_features rows", w("customers"), c("f.n")), ("2 label_complete", w("labeled"), c("f.labeled")), ("3 eval rows", w("eval"), c("f.ev")),
        ("4 to predict", w("new"), c("f.new")), ("5 train before eval", "true", c("f.apart")), ("6 mart rows", w("mart"), c("m.n")),
        ("7 null/negative preds", "0", c("m.bad")), ("8 regression MAE < global", c("g"), c("r"), c("r") < c("g")),
        ("9 regular type pred ratio", ">=1.5", c("s"), c("s") >= 1.5)])
