"""URL filters: rules, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes are pooled up the chain host - registered domain - suffix - all pages.
On every level the children's outcomes give a beta-binomial prior strength by the method of
moments (their spread around the parents' means, beyond binomial noise); a node's posterior
mean shrinks its own outcomes to its parent's mean by that strength. A page is blocked where
the upper bound of its host's good rate, the ``level`` quantile of its beta posterior, stays below
``min_good``: where the posterior holds more than ``level`` below it. Hosts without labelled pages
inherit their domain's mean.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.session import materialise

#: (host, path, verdict): fits the host and its subdomains if a path starts with the rule's.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Suffixes of two labels under which names are registered; a parameter.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "com.cn", "co.za")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host in small ASCII letters; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; ports and user names don't count, addresses are their own domain."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(*suffixes)
    number = name.rlike(r"^[0-9.]+$|^\[")
    domain = F.when(number, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(number, name).when(long, two).otherwise(F.substring_index(name, ".", -1))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null; for a list of rules, at most some hundreds."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _shrunk(nodes: DataFrame, parent_mean: str) -> DataFrame:
    """``nodes`` (n, k, parent's mean) with the level's prior strength and each posterior mean."""
    m = F.least(F.greatest(F.col(parent_mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = F.sum(F.pow(F.col("k") - F.col("n") * m, 2) / (m * (1 - m)))
    level = nodes.agg(spread.alias("chi"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs"))
    rho = F.coalesce((F.col("chi") - F.col("n")) / F.when(F.col("pairs") > 0, F.col("pairs")), F.lit(0.0))
    bounded = F.least(F.greatest(rho, F.lit(0.001)), F.lit(0.9))
    strength = level.select((1 - bounded) / bounded).first()[0]  # one number
    return nodes.withColumn("strength", F.lit(strength)).withColumn("mean", (F.col("k") + F.col("strength") * m) / (F.col("n") + F.col("strength")))


#: Steps of Simpson's rule on either side of the bound.
_STEPS = 64


def beta_below(a: str, b: str, x: float) -> Column:
    """Probability below x of a beta distribution with the parameters in two columns.

    The density is integrated over the log-odds of the rate, where it has one peak, at log(a / b),
    and exponential tails; steps grow with the distance from the peak (v -> sinh v).
    """
    width, peak = f"sqrt(({a} + {b}) / ({a} * {b}))", f"ln({a} / {b})"
    reach = f"asinh(8D + 40D / (least({a}, {b}) * {width}))"
    split = f"greatest(least(asinh((ln({x}D / (1D - {x}D)) - {peak}) / {width}), {reach}), -{reach})"
    log_density = f"({a} * (u) - ({a} + {b}) * (greatest(u, 0D) + log1p(exp(-abs(u)))))"

    def part(low: str, high: str) -> str:
        v = f"({low} + (({high}) - ({low})) * i / {_STEPS}D)"
        point = log_density.replace("(u", f"({peak} + {width} * sinh({v})")
        height = f"exp({point} - {log_density.replace('(u', f'({peak}')}) * cosh({v})"
        weight = f"CASE WHEN i IN (0, {_STEPS}) THEN 1D WHEN i % 2 = 1 THEN 4D ELSE 2D END"
        return f"(({high}) - ({low})) * aggregate(sequence(0, {_STEPS}), 0D, (s, i) -> s + {weight} * {height})"

    return F.expr(f"transform(array(struct({part('-' + reach, split)} AS p, {part(split, reach)} AS q)), z -> z.p / (z.p + z.q))[0]")


def host_reputation(hosts: DataFrame, min_good: float = 0.5) -> DataFrame:
    """[host, mean, below] from [host, domain, suffix, n, k]: posterior mean of the good rate, and the probability that it is under ``min_good``."""
    total = hosts.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1.0) / (F.coalesce(F.sum("n"), F.lit(0)) + 2.0)).alias("root")).first()[0]
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("root", F.lit(total))
    suffixes = materialise(_shrunk(suffixes, "root").select("suffix", F.col("mean").alias("suffix_mean")), "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains = materialise(_shrunk(domains, "suffix_mean").select("domain", "suffix", F.col("mean").alias("domain_mean")), "domains")
    own = _shrunk(hosts.join(domains, ["domain", "suffix"]), "domain_mean")
    weight = F.col("n") + F.col("strength")
    own = own.select("host", "mean", (F.col("mean") * weight).alias("a"), ((1 - F.col("mean")) * weight).alias("b"))
    return own.select("host", "mean", beta_below("a", "b", min_good).alias("below"))


def filter_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_good: float = 0.5,
    level: float = 0.95,
) -> DataFrame:
    """[page_id, host, path, rule, verdict, good_rate, below] of every page; ``below``: probability of a good rate under ``min_good``.

    ``outcomes`` has [url, good] rows (good 0 or 1) of labelled pages. A rule's verdict stands
    before the reputation's.

    Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
    rule and is judged by the outcomes of all such pages; null outcomes are left out; repeated
    pages are judged each; without any outcomes every host is at the prior and allowed; an empty
    table gives an empty result; other columns are ignored. Host and path are compared as they
    are written but for A-Z in hosts.
    """
    host, path = split_url(F.col("url"))
    named = pages.select("page_id", host.alias("host"), path.alias("path"))
    seen = outcomes.where(F.col("good").isNotNull()).select(host.alias("host"), F.lit(1).alias("n"), F.col("good").cast("long").alias("k"))
    counted = named.select("host", F.lit(0).alias("n"), F.lit(0).cast("long").alias("k")).unionByName(seen)
    domain, suffix = registered(F.col("host"))
    hosts = counted.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = materialise(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    reputation = materialise(host_reputation(hosts, min_good), "reputation")
    judged = named.join(reputation, "host").withColumn("_found", matching_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("below") > level, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_found.rule").alias("rule"),
        F.coalesce("_found.verdict", by_method).alias("verdict"),
        F.col("mean").alias("good_rate"),
        "below",
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page: [page_id, host, path, rule, verdict].

    A page's outcome is the label of the document that its path numbers: good if its quality
    is 1 and it isn't toxic.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.groupBy("doc_id").agg(F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("good"))
    number = F.regexp_extract(split_url(F.col("url"))[1], r"^/[^/]*/(\d{1,18})", 1)
    numbered = pages.withColumn("_n", number).select("url", F.expr("try_cast(_n AS bigint)").alias("doc_id"))
    outcomes = numbered.where("doc_id IS NOT NULL").join(good.hint("merge"), "doc_id").select("url", "good")
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


ORACLE = {
    "op7_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
g AS (SELECT doc_id, min((coalesce(quality = 1, false) AND coalesce(toxic = 0, false))::INT) AS good FROM labels GROUP BY doc_id),
o AS (SELECT p.host, g.good FROM p JOIN g ON try_cast(regexp_extract(p.path, '^/[^/]*/(\d{1,18})', 1) AS BIGINT) = g.doc_id),
c AS (SELECT host, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM (SELECT host, 0 AS n, 0 AS k FROM p UNION ALL SELECT host, 1, good FROM o) GROUP BY host),
nm AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS name FROM c),
d1 AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two, regexp_matches(name, '^[0-9.]+$|^\[') AS num FROM nm),
h AS (SELECT host, n, k, CASE WHEN num THEN name WHEN two IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','com.cn','co.za')
        THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain,
        CASE WHEN num THEN name WHEN two IN ('co.uk','org.uk','ac.uk','com.au','com.br','co.jp','co.in','co.nz','com.cn','co.za')
        THEN two ELSE string_split(name, '.')[-1] END AS suffix FROM d1),
r AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS root FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, least(greatest(any_value(root), 1e-6), 1 - 1e-6) AS m FROM h, r GROUP BY suffix),
sr AS (SELECT least(greatest(coalesce((sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.9) AS rho FROM s0),
s AS (SELECT suffix, (k + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS mean FROM s0, sr),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(k) AS k, least(greatest(any_value(s.mean), 1e-6), 1 - 1e-6) AS m FROM h JOIN s USING (suffix) GROUP BY domain, h.suffix),
dr AS (SELECT least(greatest(coalesce((sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.9) AS rho FROM d0),
d AS (SELECT domain, suffix, (k + (1 - rho) / rho * m) / (n + (1 - rho) / rho) AS mean FROM d0, dr),
h0 AS (SELECT host, n, k, least(greatest(d.mean, 1e-6), 1 - 1e-6) AS m FROM h JOIN d USING (domain, suffix)),
hr AS (SELECT least(greatest(coalesce((sum(pow(k - n * m, 2) / (m * (1 - m))) - sum(n)) / nullif(sum(n * (n - 1)), 0), 0), 0.001), 0.9) AS rho FROM h0),
hm AS (SELECT host, (k + (1 - rho) / rho * m) AS a, n + (1 - rho) / rho - (k + (1 - rho) / rho * m) AS b FROM h0, hr),
hw AS (SELECT *, sqrt((a + b) / (a * b)) AS width, ln(a / b) AS peak FROM hm),
hv AS (SELECT *, asinh(8 + 40 / (least(a, b) * width)) AS reach FROM hw),
hs AS (SELECT *, greatest(least(asinh(-peak / width), reach), -reach) AS split, a * peak - (a + b) * (greatest(peak, 0) + ln(1 + exp(-abs(peak)))) AS top FROM hv),
hp AS (SELECT host, x.side, i, CASE x.side WHEN 0 THEN split + reach ELSE reach - split END AS span,
    CASE x.side WHEN 0 THEN -reach ELSE split END + span * i / 64.0::DOUBLE AS v, peak + width * sinh(v) AS u,
    span * CASE WHEN i IN (0, 64) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - top) * cosh(v) AS y
  FROM hs, (VALUES (0), (1)) x(side), range(65) r(i)),
v AS (SELECT host, CASE WHEN sum(y) FILTER (side = 0) / sum(y) > 0.95 THEN 'block' ELSE 'allow' END AS verdict FROM hp GROUP BY host),
rules(name, start, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT p.*, (SELECT arg_max({'rule': name || start, 'verdict': x.verdict}, length(name || start)) FROM rules x
        WHERE (p.host = x.name OR ends_with(p.host, '.' || x.name)) AND starts_with(p.path, x.start)) AS found FROM p)
SELECT page_id, f.host, path, found.rule AS rule, coalesce(found.verdict, v.verdict) AS verdict FROM f JOIN v ON f.host = v.host
"""
}
