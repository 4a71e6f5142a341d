"""Operator 12: URL filter by host reputation, in DataFrame functions only.

Hand-written rules judge the urls that they fit. Their verdicts are the labelled outcomes from which every other url is judged: the good rate
of a host is shrunk towards its registered domain's, the domain's towards its suffix's and the suffix's towards that of all labelled pages.
Each of the three levels has a beta prior whose mean is the posterior mean of the level above and whose weight (in pages) is the
moment estimate for a beta-binomial at that level, one number for all its groups:

    1 / (weight + 1) = sum((good - n * mean)**2 - n * mean * (1 - mean)) / sum(n * (n - 1) * mean * (1 - mean))

kept between the bounds of ``WEIGHTS``. A url without a rule is blocked when the upper posterior bound of its host's good rate (mean plus ``z``
standard deviations of its beta posterior) stays under ``threshold``; so a host that nobody has labelled is blocked only where the
levels above leave no doubt.

A host's registered domain is its last two labels, its suffix the last one; three and two where the last is a country code of two
letters and the one before is listed in ``SECOND_LEVEL``. A host of one label, or one that ends in a number, is its own domain and suffix.

Defined results: a url that is null or has no ``://`` has an empty host and path, fits no rule and is judged as a host without labels of its own
suffix, the empty one; repeated rows each come back; a null page_id stays null; without any labelled page every mean is 1/2 and no url is blocked;
an empty table gives no rows; other columns, whatever their names, are left behind; the length of a url does not matter.

Scale: urls are reduced to one row per host (``labelled``, ``good``, ``pages``) before any shuffle ends, and all priors come from that
table. The way back from hosts to pages is ``join_hot``: keys with more than one in ``SHARE`` of the rows are broadcast (there can be at most
``SHARE`` of them), all others go through a shuffle in which no key is larger than that share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

SHARE = 1000
# Pages that a prior counts for: at least, at most, and where nothing can be estimated.
WEIGHTS = (1.0, 1000.0, 10.0)
# Labels that stand before a country code in registered suffixes.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))


def with_address(pages: DataFrame, url: str = "url") -> DataFrame:
    """Columns ``host`` and ``path`` next to the given ones."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.withColumn("path", F.coalesce(path, F.lit(""))).withColumn("host", F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")))


def first_rule(rules: tuple[Rule, ...]) -> Column:
    """Struct of the longest rule that fits ``host`` and ``path``, else null; of equally long ones that with the longer host."""
    if len({r.text for r in rules}) < len(rules):
        raise ValueError("two rules for one address")
    order = sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text), reverse=True)
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in order], none)


def domain_and_suffix(host: str = "host") -> tuple[Column, Column]:
    parts = F.split(F.col(host), r"\.")
    n = F.size(parts)
    last = F.substring_index(F.col(host), ".", -1)
    second = F.element_at(parts, F.when(n > 1, F.lit(-2)).otherwise(F.lit(-1)))
    alone = (n < 2) | last.rlike("^[0-9]*$")
    wide = (n > 2) & last.rlike("^[a-z]{2}$") & second.isin(*SECOND_LEVEL)
    take = lambda k: F.substring_index(F.col(host), ".", -k)
    domain = F.when(alone, F.col(host)).when(wide, take(3)).otherwise(take(2))
    suffix = F.when(alone, F.col(host)).when(wide, take(2)).otherwise(last)
    return domain, suffix


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, spread: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row per ``key`` and says in ``weight`` how many of ``rows`` have it.

    ``spread`` is a column of ``rows`` with many values; it deals out the rows whose key has been served by the broadcast side.
    """
    names = [c for c in keyed.columns if c not in (key, weight)]
    everything = keyed.agg(F.sum(weight)).first()[0] or 0
    hot = keyed.where(F.col(weight) * SHARE > everything).select(F.col(key).alias("_hot"), F.struct(*names).alias("_of_hot"))
    rest = keyed.where(F.col(weight) * SHARE <= everything).select(F.struct(F.col(key).alias("k"), F.lit(None).cast("string").alias("s")).alias("_rest"), F.struct(*names).alias("_of_rest"))
    with_hot = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    at = F.struct(F.when(F.col("_hot").isNull(), F.col(key)).alias("k"), F.when(F.col("_hot").isNotNull(), F.xxhash64(spread).cast("string")).alias("s"))
    both = with_hot.withColumn("_at", at).join(rest, F.col("_at").eqNullSafe(F.col("_rest")), "left")
    found = F.coalesce(F.col("_of_hot"), F.col("_of_rest"))
    return both.select(*rows.columns, *[found[c].alias(c) for c in names])


def _weight(groups: DataFrame) -> float:
    """Weight of the prior at a level, from ``n``, ``good`` and the mean ``above`` of each group."""
    spread = F.col("above") * (1 - F.col("above"))
    extra = F.sum(F.pow(F.col("good") - F.col("n") * F.col("above"), 2) - F.col("n") * spread)
    room = F.sum(F.col("n") * (F.col("n") - 1) * spread)
    extra, room = groups.agg(extra, room).first()
    least, most, unknown = WEIGHTS
    if not room or room <= 0:
        return unknown
    share = min(max(extra / room, 1 / (most + 1)), 1 / (least + 1))
    return 1 / share - 1


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups`` with the counts ``a``, ``b`` of each one's posterior; ``above`` goes."""
    weight = _weight(groups)
    a = F.col("good") + weight * F.col("above")
    b = F.col("n") - F.col("good") + weight * (1 - F.col("above"))
    return groups.withColumns({"a": a, "b": b}).drop("above", "n", "good")


def host_posteriors(hosts: DataFrame) -> DataFrame:
    """Beta posterior ``a``, ``b`` of the good rate of each ``host``, from its labelled pages ``n`` and the ``good`` ones of them; other columns stay.

    The tables of the levels are written to the shared folder: each is read twice, for the weight of its prior and for its groups.
    """
    domain, suffix = domain_and_suffix()
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("members")]
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = materialize(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = materialize(domains.groupBy("suffix").agg(*sums))
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("above")
    top = _shrunk(suffixes.withColumn("above", F.lit(((good or 0) + 1) / ((n or 0) + 2))))
    middle = materialize(join_hot(domains, top.select("suffix", "members", mean), "suffix", "domain", "members"))
    low = _shrunk(middle).select("domain", "members", mean)
    return _shrunk(materialize(join_hot(hosts, low, "domain", "host", "members"))).drop("domain", "suffix")


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, host, path, rule, verdict, upper (the posterior bound of the host, rounded to six digits) per row of ``pages``."""
    parsed = with_address(pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"))).drop("url").withColumn("r", first_rule(rules))
    counts = [F.count("*").alias("pages"), F.count("r").alias("n"), F.coalesce(F.sum((F.col("r.verdict") == "allow").cast("long")), F.lit(0)).alias("good")]
    hosts = materialize(parsed.groupBy("host").agg(*counts))
    a, b = F.col("a"), F.col("b")
    upper = a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = materialize(host_posteriors(hosts).select("host", "pages", upper.alias("upper")))
    known = join_hot(parsed, judged, "host", "page_id", "pages")
    own = F.when(F.col("upper") < threshold, "block").otherwise("allow")
    return known.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), F.round("upper", 6).alias("upper"))


def url_sql(rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645) -> str:
    """The same rows in DuckDB's SQL, the levels written out one by one."""
    listed = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in rules)
    least, most, unknown = WEIGHTS

    def level(name: str, source: str, key: str) -> str:
        spread = "above * (1 - above)"
        return f"""{name}_w AS (SELECT CASE WHEN coalesce(room, 0) <= 0 THEN {unknown}::DOUBLE
        ELSE 1 / least(greatest(extra / room, 1 / ({most} + 1)::DOUBLE), 1 / ({least} + 1)::DOUBLE) - 1 END AS w
    FROM (SELECT sum((good - n * above) ** 2 - n * {spread}) AS extra, sum(n * (n - 1) * {spread}) AS room FROM {source})),
{name} AS (SELECT {key}, good + w * above AS a, n - good + w * (1 - above) AS b FROM {source}, {name}_w)"""

    return f"""
WITH rules(rule, rhost, rpath, verdict) AS (VALUES {listed}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
addr AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
places AS (SELECT DISTINCT host, path FROM addr),
ruled AS (SELECT host, path, arg_max(rule, length(rule) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rule) * 1000 + length(rhost)) AS verdict
    FROM places JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
page AS (SELECT addr.*, rule, verdict FROM addr LEFT JOIN ruled USING (host, path)),
hosts AS (SELECT host, count(rule)::DOUBLE AS n, count(*) FILTER (verdict = 'allow')::DOUBLE AS good FROM page GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS p FROM hosts),
kinds AS (SELECT *, CASE WHEN len(p) < 2 OR regexp_matches(p[-1], '^[0-9]*$') THEN 0
    WHEN len(p) > 2 AND regexp_matches(p[-1], '^[a-z]{{2}}$') AND p[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS k FROM parts),
h AS (SELECT host, n, good, CASE k WHEN 0 THEN host ELSE array_to_string(p[-(k + 1):], '.') END AS domain,
    CASE k WHEN 0 THEN host ELSE array_to_string(p[-k:], '.') END AS suffix FROM kinds),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
s_up AS (SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM s) AS above FROM s),
{level("s_post", "s_up", "suffix")},
d_up AS (SELECT d.*, a / (a + b) AS above FROM d JOIN s_post USING (suffix)),
{level("d_post", "d_up", "domain")},
h_up AS (SELECT h.*, a / (a + b) AS above FROM h JOIN d_post USING (domain)),
{level("h_post", "h_up", "host")},
bound AS (SELECT host, a / (a + b) + {z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h_post)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN upper < {threshold} THEN 'block' ELSE 'allow' END) AS verdict, round(upper, 6) AS upper
FROM page JOIN bound USING (host)
"""
