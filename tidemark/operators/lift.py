"""Creative performance and the stratified lift of design features."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checks import check_rows, fingerprint, one_row, symmetric_difference, union_all
from ..functions.paging import PAGE, list_pages, page_text
from ..functions.exprs import count_rows, ratio
from .quality import unpivot_flags

ATTRS = ("person", "cta", "warm", "text")
Z95 = 1.96


def creative_conversion(events: DataFrame, skip_days: Sequence[date] = (), start: date | None = None, end: date | None = None) -> DataFrame:
    """F-01: sessions per creative and how many of them bought in the same session; days with broken tracking are left out."""
    e = events.where("data_source = 'synthetic'")
    if start is not None:
        e = e.where(F.col("event_dt") >= F.lit(start))
    in_range = e if end is None else e.where(F.col("event_dt") <= F.lit(end))
    opened = in_range.where((F.col("event_name") == "session_start") & (F.coalesce("creative_id", F.lit("")) != ""))
    if skip_days:
        opened = opened.where(~F.col("event_dt").isin(list(skip_days)))
    keys = ["user_pseudo_id", "ga_session_id"]
    sess = opened.groupBy(*keys).agg(F.min("creative_id").alias("creative_id"))
    # purchases may fall just after midnight of the last day
    late = e if end is None else e.where(F.col("event_dt") <= F.date_add(F.lit(end), 1))
    buy = late.where("event_name = 'purchase'").select(*keys).distinct().withColumn("bought", F.lit(1))
    return sess.join(buy, keys, "left").groupBy("creative_id").agg(count_rows().alias("sessions"), F.count("bought").alias("converted"))


def creative_perf(creatives: DataFrame, flags: DataFrame, ads: DataFrame, conversion: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """F-02: one row per image: flags, impressions, clicks, click rate, sessions, conversion rate. Images without clicks drop out."""
    img = creatives.where((F.col("format") == "image") & ~F.col("creative_id").isin(list(exclude))) \
        .select("creative_id", "channel", "audience", "utm_campaign").join(flags, "creative_id")
    seen = ads.where("data_source = 'synthetic'").groupBy("creative_id").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return img.join(seen, "creative_id").where("clicks > 0").join(conversion, "creative_id", "left").withColumns(
        {"ctr": ratio("clicks", "impressions"), "cvr": ratio("converted", "sessions")})


def _long(perf: DataFrame, *extra: str) -> DataFrame:
    return unpivot_flags(perf, ["creative_id", "channel", "audience", "ctr", "sessions", "converted", *extra], ATTRS)


def _side(p: Column, c: str) -> Column:
    return F.sum(F.when(p, F.col(c)).otherwise(0))


def _geo_ratio() -> Column:
    flag = F.col("flag")
    return F.exp(F.avg(F.when(flag, F.log("ctr")))) / F.exp(F.avg(F.when(~flag, F.log("ctr"))))


def _cvr_ratio() -> Column:
    flag = F.col("flag")
    rate = lambda p: ratio(_side(p, "converted"), _side(p, "sessions"))
    return ratio(rate(flag), rate(~flag))


def strata(perf: DataFrame) -> DataFrame:
    """F-03: per feature and channel x audience: images on each side, click-rate and conversion-rate ratios."""
    flag = F.col("flag")
    return _long(perf).groupBy("attr", "channel", "audience").agg(
        F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn"), _geo_ratio().alias("ctr_ratio"),
        _side(flag, "converted").alias("cy"), _side(~flag, "converted").alias("cn"), _cvr_ratio().alias("cvr_ratio")).where("ny > 0 and nn > 0")


def _pair_weight() -> Column:
    return F.col("ny") * F.col("nn") / (F.col("ny") + F.col("nn"))


def _inverse_variance(p: Column) -> Column:
    return F.when(p, 1 / (F.try_divide(F.lit(1), F.col("cy")) + F.try_divide(F.lit(1), F.col("cn"))))


def pooled(st: DataFrame) -> DataFrame:
    """F-04: strata combined; the conversion rate with log standard error, strata without conversions on a side skipped."""
    both = (F.col("cy") > 0) & (F.col("cn") > 0)
    w, iv = _pair_weight(), _inverse_variance(both)
    return st.groupBy("attr").agg(
        count_rows().alias("strata_used"), F.exp(F.sum(F.log("ctr_ratio") * w) / F.sum(w)).alias("ctr_est"),
        F.exp(F.try_divide(F.sum(F.when(both, F.log("cvr_ratio")) * iv), F.sum(iv))).alias("cvr_est"),
        F.try_divide(F.lit(1.0), F.sqrt(F.sum(iv))).alias("cvr_log_se"), F.count_if(~both).alias("cvr_strata_skipped"))


def naive_ratio(perf: DataFrame) -> DataFrame:
    """F-05: the same comparison without strata."""
    flag = F.col("flag")
    return _long(perf).groupBy("attr").agg(
        _geo_ratio().alias("ctr_naive"), _cvr_ratio().alias("cvr_naive"), F.count_if(flag).alias("images_yes"), F.count_if(~flag).alias("images_no"),
        _side(flag, "converted").alias("converted_yes"), _side(~flag, "converted").alias("converted_no"))


def creative_lift(perf: DataFrame) -> DataFrame:
    """The lift mart: feature x metric, stratified next to naive, 95 % interval for the conversion rate."""
    c = F.col
    none = F.lit(None)
    ctr = F.struct(F.lit("ctr").alias("metric"), c("ctr_est").alias("stratified"), c("ctr_naive").alias("naive"), F.lit(0).cast("bigint").alias("strata_skipped"),
                   none.cast("double").alias("ci95_low"), none.cast("double").alias("ci95_high"), none.cast("bigint").alias("converted_yes"), none.cast("bigint").alias("converted_no"))
    cvr = F.struct(F.lit("cvr").alias("metric"), c("cvr_est").alias("stratified"), c("cvr_naive").alias("naive"), c("cvr_strata_skipped").alias("strata_skipped"),
                   (c("cvr_est") * F.exp(-Z95 * c("cvr_log_se"))).alias("ci95_low"), (c("cvr_est") * F.exp(Z95 * c("cvr_log_se"))).alias("ci95_high"),
                   c("converted_yes").alias("converted_yes"), c("converted_no").alias("converted_no"))
    return pooled(strata(perf)).join(naive_ratio(perf), "attr").select("attr", "strata_used", "images_yes", "images_no", F.inline(F.array(ctr, cvr)))


def perf_listing(perf: DataFrame) -> DataFrame:
    """F-06."""
    return perf.select("channel", "audience", "creative_id", *[f"f_{a}" for a in ATTRS], "impressions", "clicks", F.round(100 * F.col("ctr"), 2).alias("ctr_pct"),
                       "sessions", "converted", F.round(100 * F.col("cvr"), 2).alias("cvr_pct")).orderBy("channel", "audience", F.desc("ctr_pct"))


def lift_listing(lift: DataFrame) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return lift.select("metric", "attr", r("stratified", 3), r("naive", 3), r("ci95_low", 2), r("ci95_high", 2), "strata_used", "strata_skipped",
                       "images_yes", "images_no", "converted_yes", "converted_no").orderBy("metric", "attr")


def lift_by_stratum(perf: DataFrame) -> DataFrame:
    flag = F.col("flag")
    geo = lambda p: F.exp(F.avg(F.when(p, F.log("ctr"))))
    return _long(perf).groupBy("attr", "channel", "audience").agg(
        F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn"), F.round(100 * geo(flag), 2).alias("ctr_yes_pct"),
        F.round(100 * geo(~flag), 2).alias("ctr_no_pct"), F.round(_geo_ratio(), 3).alias("ratio"))


def jackknife_lift(perf: DataFrame) -> DataFrame:
    """F-07: range of the pooled click-rate lift when any one image is left out, and which image causes the extremes.

    Leaving out an image changes only its own stratum, so each estimate comes from that stratum's sums without the image and
    the feature's totals: linear in the number of images, no image x image pairs.
    """
    flag, keys = F.col("flag"), ["attr", "channel", "audience"]
    long = _long(perf).withColumn("ln", F.log("ctr"))
    sums = long.groupBy(*keys).agg(F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn"), _side(flag, "ln").alias("sy"), _side(~flag, "ln").alias("sn"))

    def part(ny: Column, nn: Column, sy: Column, sn: Column) -> tuple[Column, Column]:
        ok = (ny > 0) & (nn > 0)
        w = F.when(ok, F.try_divide(ny * nn, ny + nn)).otherwise(0.0)
        return F.when(ok, (F.try_divide(sy, ny) - F.try_divide(sn, nn)) * w).otherwise(0.0), w

    c = F.col
    num, w = part(c("ny"), c("nn"), c("sy"), c("sn"))
    sums = sums.withColumns({"num": num, "w": w})
    totals = sums.groupBy("attr").agg(F.sum("num").alias("num_all"), F.sum("w").alias("w_all"))
    y, n = F.when(flag, 1).otherwise(0), F.when(flag, 0).otherwise(1)
    num1, w1 = part(c("ny") - y, c("nn") - n, c("sy") - y * c("ln"), c("sn") - n * c("ln"))
    est = F.exp(ratio(c("num_all") - c("num") + num1, c("w_all") - c("w") + w1))
    jk = long.join(sums, keys).join(totals, "attr").select("attr", c("creative_id").alias("dropped"), F.round(est, 12).alias("est")).where("est is not null")
    order = F.struct("est", "dropped")
    return jk.groupBy("attr").agg(F.round(F.min("est"), 3).alias("min_est"), F.round(F.max("est"), 3).alias("max_est"),
                                  F.min_by("dropped", order).alias("drop_for_min"), F.max_by("dropped", order).alias("drop_for_max"))


def orders_per_impression_lift(perf: DataFrame, ads: DataFrame, skip_days: Sequence[date] = ()) -> DataFrame:
    """F-08: stratified ratio of conversions per impression with interval, and rates per 10,000."""
    shown = ads.where("data_source = 'synthetic'")
    if skip_days:
        shown = shown.where(~F.col("date").isin(list(skip_days)))
    imp = shown.groupBy("creative_id").agg(F.sum("impressions").alias("imp"))
    flag, c = F.col("flag"), F.col
    st = _long(perf.join(imp, "creative_id"), "imp").groupBy("attr", "channel", "audience").agg(
        _side(flag, "converted").alias("cy"), _side(~flag, "converted").alias("cn"), _side(flag, "imp").alias("iy"), _side(~flag, "imp").alias("iv"),
        F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn")).where("ny > 0 and nn > 0")
    both = (c("cy") > 0) & (c("cn") > 0)
    inv = _inverse_variance(both)
    log_ratio = F.when(both, F.log(ratio(ratio("cy", "iy"), ratio("cn", "iv"))))
    est = F.exp(F.try_divide(F.sum(log_ratio * inv), F.sum(inv)))
    se = F.try_divide(F.lit(1.0), F.sqrt(F.sum(inv)))
    p = st.groupBy("attr").agg(est.alias("est"), se.alias("se"), ratio(F.sum("cy"), F.sum("iy")).alias("ry"), ratio(F.sum("cn"), F.sum("iv")).alias("rn"))
    return p.select("attr", F.round("est", 3).alias("orders_per_imp_stratified"), F.round(c("est") * F.exp(-Z95 * c("se")), 2).alias("ci95_low"),
                    F.round(c("est") * F.exp(Z95 * c("se")), 2).alias("ci95_high"), F.round(10000 * c("ry"), 2).alias("per10k_yes"),
                    F.round(10000 * c("rn"), 2).alias("per10k_no"))


def planted_effects(signals: DataFrame, signal_id: str = "S4") -> dict[str, Column]:
    """Multipliers from the answer table; the JSON may be stored directly or once more encoded as a JSON string."""
    spec = F.col("spec")
    inner = F.coalesce(F.when(spec.startswith('"'), F.from_json(F.concat(F.lit('{"s":'), spec, F.lit("}")), "s string")["s"]), spec)
    one = signals.where(F.col("signal_id") == signal_id).withColumn("_s", inner)
    value = lambda k: one.agg(F.max(F.get_json_object("_s", f"$.{k}").try_cast("double"))).scalar()
    return {"person": value("has_person"), "cta": value("cta_bottom_right"), "warm": value("dominant_color_warm")}


def lift_vs_truth(perf: DataFrame, lift: DataFrame, truth: DataFrame, effects: dict[str, Column]) -> DataFrame:
    """F-09: lift from read flags, from specified flags, the noise-free expectation and the planted answer.

    ``truth`` is (creative_id, t_person, t_cta, t_warm, t_text).
    """
    c = F.col
    ideal = F.lit(1.0)
    for k, e in effects.items():
        ideal = ideal * F.when(c(f"t_{k}"), e).otherwise(F.lit(1.0))
    j = perf.join(truth, "creative_id")
    spec = j.select("channel", "audience", "ctr", ideal.alias("ideal"), *[c(f"t_{a}").alias(f"f_{a}") for a in ATTRS])
    flag = c("flag")
    geo = lambda v: F.exp(F.avg(F.when(flag, F.log(v))) - F.avg(F.when(~flag, F.log(v))))
    st = unpivot_flags(spec, ["channel", "audience", "ctr", "ideal"], ATTRS).groupBy("attr", "channel", "audience").agg(
        F.count_if(flag).alias("ny"), F.count_if(~flag).alias("nn"), geo("ctr").alias("r"), geo("ideal").alias("ri")).where("ny > 0 and nn > 0")
    w = _pair_weight()
    est = st.groupBy("attr").agg(F.exp(F.sum(F.log("r") * w) / F.sum(w)).alias("spec_est"), F.exp(F.sum(F.log("ri") * w) / F.sum(w)).alias("no_noise"))
    differing = differing_images(perf, truth)
    n, ids = differing.agg(count_rows()).scalar(), page_text(differing, [], "creative_id", separator=", ").select("items").scalar()
    answer = F.lit(1.0)
    for k, e in effects.items():
        answer = F.when(c("attr") == k, e).otherwise(answer)
    return lift.where("metric = 'ctr'").join(est, "attr").select(
        "attr", F.round("stratified", 3).alias("ai_features"), F.round("spec_est", 3).alias("spec_features"), F.round("no_noise", 3).alias("no_noise"),
        answer.alias("answer"), n.alias("flag_differs_images"), F.coalesce(ids, F.lit("")).alias("flag_differs_ids"))


def differing_images(perf: DataFrame, truth: DataFrame, size: int = PAGE) -> DataFrame:
    """F-09: images whose flags as read differ from those specified, as numbered rows."""
    differs = F.lit(False)
    for a in ATTRS:
        differs = differs | (F.col(f"f_{a}") != F.col(f"t_{a}"))
    return list_pages(perf.join(truth, "creative_id").where(differs), [], "creative_id", size)


def measured_s4(lift: DataFrame) -> DataFrame:
    """The five numbers judged for S4; the last one is the conversion lift furthest from 1, kept with its direction."""
    ids = {"person": "S4a", "cta": "S4b", "warm": "S4c", "text": "S4d"}
    name = F.lit(None).cast("string")
    for a, i in ids.items():
        name = F.when(F.col("attr") == a, i).otherwise(name)
    ctr = lift.where("metric = 'ctr'").select(name.alias("check_id"), F.col("stratified").alias("actual"))
    furthest = lift.where("metric = 'cvr' and attr in ('person', 'cta', 'warm') and stratified is not null").agg(
        F.lit("S4e").alias("check_id"), F.max_by("stratified", F.struct(F.abs(F.log("stratified")), "attr")).alias("actual"))
    return ctr.unionByName(furthest)


VERDICTS = {"pending": "待考", "no_data": "沒有資料", "found": "找到", "missed": "沒找到"}  # fixed values


def judge(criteria: DataFrame, measured: DataFrame, pending: bool = True) -> DataFrame:
    """Bounds check of measured values; a criterion without bounds is pending."""
    c = F.col
    verdict = F.when(c("actual").isNull(), VERDICTS["no_data"]).when(c("actual").between(c("lower_bound"), c("upper_bound")), VERDICTS["found"]).otherwise(VERDICTS["missed"])
    if pending:
        verdict = F.when(c("lower_bound").isNull(), VERDICTS["pending"]).otherwise(verdict)
    return criteria.join(measured, "check_id", "left").select(
        "signal_id", "check_id", "found_by", "method", "rule", "lower_bound", "upper_bound", F.round("actual", 3).alias("actual"), verdict.alias("verdict"))


def score_s4(criteria: DataFrame, lift: DataFrame) -> DataFrame:
    """F-10."""
    return judge(criteria.where("signal_id = 'S4'"), measured_s4(lift), pending=False)


def scoring_run(criteria: DataFrame, scored_at: Column | None = None) -> DataFrame:
    """F-11: the row appended at every scoring: when, and the fingerprint of the criteria used."""
    return fingerprint(criteria).withColumn("scored_at", F.current_timestamp() if scored_at is None else scored_at)


def check_lift(perf: DataFrame, lift: DataFrame, dim_creative: DataFrame, features: DataFrame, criteria_v1: DataFrame, criteria_v2: DataFrame,
               scorecard: DataFrame, runs: DataFrame, images: int, excluded: Sequence[str], strata_wanted: int, answers: Column) -> DataFrame:
    """F-12: sixteen checks."""
    c = F.col
    design = sum(x in dim_creative.columns for x in ("has_person", "cta_position", "dominant_color", "text_density"))
    bad = lambda *cols: F.exists(F.array(*[c(x).cast("bigint") for x in cols]), lambda x: F.coalesce(x, F.lit(0)) == 0)
    null_flag = F.lit(False)
    for a in ATTRS:
        null_flag = null_flag | c(f"f_{a}").isNull()
    shared = ["signal_id", "check_id", "rule", "lower_bound", "upper_bound"]
    changed = symmetric_difference(criteria_v1.where("signal_id <> 'S4'").select(*shared), criteria_v2.where("signal_id <> 'S4'").select(*shared))
    now = fingerprint(criteria_v2).select("fingerprint").scalar()
    struct = lambda df, **a: df.agg(F.struct(*[v.alias(k) for k, v in a.items()])).scalar()
    facts = one_row(
        perf.sparkSession, f=struct(features, n=count_rows()),
        p=struct(perf, n=count_rows(), ex=F.count_if(c("creative_id").isin(list(excluded))), no_ad=F.count_if(bad("impressions", "clicks")),
                 no_sess=F.count_if(bad("sessions")), over=F.count_if(c("sessions") > c("clicks")), nf=F.count_if(null_flag)),
        l=struct(lift, n=count_rows(), nulls=F.count_if(c("stratified").isNull()), ms=F.min("strata_used"), sk=F.sum("strata_skipped")),
        v=struct(changed, n=count_rows()), s=struct(scorecard, n=count_rows(), nd=F.count_if(c("verdict") == VERDICTS["no_data"])),
        r=struct(runs, kinds=F.count_distinct("fingerprint"), same=F.bool_and(c("fingerprint") == now)), a=F.struct(answers.alias("n")))
    return check_rows(facts, [
        ("01 features table images", str(images), c("f.n")),
        ("02 perf images without the excluded", str(images - len(excluded)), c("p.n")),
        ("03 excluded image not in perf", "0", c("p.ex")),
        ("04 every image has impressions and clicks", "0", c("p.no_ad")),
        ("05 every image has sessions", "0", c("p.no_sess")),
        ("06 sessions never exceed clicks", "0", c("p.over")),
        ("07 no NULL feature flag", "0", c("p.nf")),
        ("08 lift rows", str(2 * len(ATTRS)), c("l.n")),
        ("09 no NULL stratified estimate", "0", c("l.nulls")),
        ("10 each estimate uses all strata", str(strata_wanted), c("l.ms")),
        ("11 no stratum skipped", "0", c("l.sk")),
        ("12 no design columns in dim_creative", "0", F.lit(str(design))),
        ("13 second criteria keep first rows", "0", c("v.n")),
        ("14 S4 scorecard rows with data", "5/0", F.concat_ws("/", c("s.n").cast("string"), c("s.nd").cast("string"))),
        ("15 S4 answer readable", "1", c("a.n")),
        ("16 criteria unchanged since first scoring", "1/true", F.concat_ws("/", c("r.kinds").cast("string"), F.coalesce(c("r.same").cast("string"), F.lit("null")))),
    ])


FEATURE_LABELS = {"person": "has a person", "cta": "button bottom right", "warm": "warm colours", "text": "much text"}


def feature_lift_lookup(lift: DataFrame, metric: str) -> DataFrame:
    """F-13."""
    if metric not in ("ctr", "cvr"):
        raise ValueError("metric must be ctr or cvr")
    label = F.col("attr")
    for a, text in FEATURE_LABELS.items():
        label = F.when(F.col("attr") == a, text).otherwise(label)
    return lift.where(F.col("metric") == metric).select(
        F.col("attr").alias("feature"), F.round("stratified", 3).alias("lift"), F.round("ci95_low", 2).alias("ci95_low"), F.round("ci95_high", 2).alias("ci95_high"),
        F.col("images_yes").alias("images_with_feature"), F.col("images_no").alias("images_without_feature"), label.alias("feature_label")).orderBy(F.desc("lift"))
