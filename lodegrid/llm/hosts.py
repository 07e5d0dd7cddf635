"""Host reputation by empirical Bayes, as an URL filter. DataFrame expressions only.

Outcomes of labelled pages (bad or not) are counted per host. The rate of a suffix is shrunk towards the rate of
all pages, that of a registered domain towards its suffix, and that of a host towards its domain, each by a
beta-binomial prior whose strength is estimated from the spread of the level's rates (analysis of variance, by the
method of moments). A url without a rule is blocked where the lower posterior bound of its host's bad rate, the ``TAIL``
quantile of the beta posterior, reaches ``LIMIT``: that is, where the posterior holds no more than ``TAIL`` below it.
That probability is an integral over the log odds, in ``STEPS`` steps of a sixteenth of a deviation to either side of the limit.

Rules come first: a rule is a host and a path beginning, fits the host and all its subdomains, and the longest that
fits decides. Rules are a list of configuration, compiled into one expression.

Pages are counted before anything is shuffled; the counts, one row per host, are stored and read for all levels, and a host
with a third of all pages is one row too. The three strengths are the only values that come to the driver. Suffixes
of more than one label are those of a table (column suffix), or ``LONG_SUFFIXES`` where none is given.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the
rate of all pages without host; pages without a label count for nothing; several labels of a page count once each;
with no labels at all every host has the rate 0; extra columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.session import materialise, spread_join

#: Lower posterior bound of the bad rate from which a url is blocked, and the share of the posterior that may lie below it.
LIMIT, TAIL = 0.5, 0.05
#: Steps of the integral on either side, steps in a deviation, and deviations from the limit at which nothing is left.
STEPS, FINE, FAR = 384, 16, 12
#: Strengths are kept within these bounds where the labels cannot tell.
STRENGTH = (1.0, 1000.0)
#: Suffixes of more than one label under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn", "com.mx", "com.tr")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path that follows it."""
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds suffix and registered domain, the suffix and one label more."""
    two, three = F.substring_index("host", ".", -2), F.substring_index("host", ".", -3)
    if suffixes is None:
        out = hosts.withColumn("_long", two.isin(*LONG_SUFFIXES))
    else:
        known = suffixes.select(F.col("suffix").alias("_two"), F.lit(True).alias("_long")).distinct()
        out = hosts.join(known, two == F.col("_two"), "left").drop("_two")
    is_long = F.coalesce("_long", F.lit(False))
    return out.withColumns({"suffix": F.when(is_long, two).otherwise(F.substring_index("host", ".", -1)), "domain": F.when(is_long, three).otherwise(two)}).drop("_long")


def below_limit(a: Column, b: Column, limit: float = LIMIT) -> Column:
    """Share of a beta distribution below ``limit``, by midpoints over the log odds."""
    step = F.sqrt(1 / a + 1 / b) / FINE
    peak, cut = F.log(a / b), math.log(limit / (1 - limit))
    soft = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))
    height = lambda u: -a * soft(-u) - b * soft(u)
    side = lambda sign: F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), F.lit(0.0), lambda total, j: (
        total + F.exp(height(F.lit(cut) + sign * (j + 0.5) * step) - height(peak))))
    low, high = side(-1), side(1)
    away = (peak - cut) / (step * FINE)
    return F.when(a <= 0, 1.0).when(b <= 0, 0.0).when(away > FAR, 0.0).when(away < -FAR, 1.0).otherwise(low / (low + high))


def _counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(children: DataFrame, parent: list[str]) -> float:
    """Prior strength of a level: how little its members' rates differ beyond chance, within their parents."""
    p = F.col("bad") / F.col("n")
    per = children.where("n > 0").groupBy(*parent).agg(
        F.count("*").alias("k"), F.sum("n").alias("N"), F.sum("bad").alias("B"),
        F.sum(F.col("n") * F.col("n")).alias("N2"), F.sum(F.col("n") * p * (1 - p)).alias("W"), F.sum(F.col("bad") * p).alias("BP"))
    row = per.agg(
        F.sum(F.col("BP") - F.col("B") * F.col("B") / F.col("N")).alias("between"), F.sum("W").alias("within"),
        F.sum(F.col("k") - 1).alias("free"), F.sum(F.col("N") - F.col("k")).alias("rest"),
        F.sum(F.col("N") - F.col("N2") / F.col("N")).alias("size")).first()
    if not row["free"] or not row["rest"]:
        return STRENGTH[0]
    size = row["size"] / row["free"]
    between, within = row["between"] / row["free"], row["within"] / row["rest"]
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return min(max(1 / rho - 1, STRENGTH[0]), STRENGTH[1]) if rho > 0 else STRENGTH[1]


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """host, n, bad, the posterior mean of the bad rate and the posterior share below ``LIMIT``, for every host of ``pages``.

    ``outcomes`` has page_id and bad (0 or 1); only pages with a non-null outcome count as evidence.
    """
    host, _ = host_and_path("url")
    labelled = outcomes.where("bad IS NOT NULL").select(F.col("page_id").alias("_page"), F.col("bad").cast("bigint").alias("_bad"))
    seen = pages.select("page_id", host.alias("host")).join(labelled, F.col("page_id") == F.col("_page"), "left")
    hosts = seen.groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad"))
    hosts = materialise(with_domains(hosts, suffixes), "hosts")
    domains = _counts(hosts, ["suffix", "domain"])
    suffixes = _counts(domains, ["suffix"])
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    base = total["bad"] / total["n"] if total["n"] else 0.0
    k_suffix, k_domain, k_host = _strength(suffixes, []), _strength(domains, ["suffix"]), _strength(hosts, ["suffix", "domain"])

    def shrunk(k: float, prior: Column) -> Column:
        return (F.lit(k) * prior + F.col("bad")) / (F.lit(k) + F.col("n"))

    by_suffix = suffixes.select("suffix", shrunk(k_suffix, F.lit(base)).alias("prior"))
    by_domain = spread_join(domains, by_suffix, ["suffix"]).select("suffix", "domain", shrunk(k_domain, F.col("prior")).alias("prior"))
    joined = spread_join(hosts, by_domain, ["suffix", "domain"])
    a, b = F.lit(k_host) * F.col("prior") + F.col("bad"), F.lit(k_host) * (1 - F.col("prior")) + F.col("n") - F.col("bad")
    joined = joined.select("host", "n", "bad", a.alias("_a"), b.alias("_b"))
    return joined.select("host", "n", "bad", (F.col("_a") / (F.col("_a") + F.col("_b"))).alias("mean"), below_limit(F.col("_a"), F.col("_b")).alias("below"))


def matched_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) columns of the longest fitting rule, over columns ``host`` and ``path``; null where none fits."""
    best = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        best, verdict = F.when(fits, host + path).otherwise(best), F.when(fits, action).otherwise(verdict)
    return best, verdict


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and how likely the host's bad rate is below ``LIMIT``."""
    host, path = host_and_path("url")
    known = reputations(pages, outcomes, suffixes).select("host", F.col("below").alias("below_limit"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(rules)
    ruled = parted.withColumns({"rule": rule, "_said": verdict})
    out = spread_join(ruled, known, ["host"])
    judged = F.when(F.col("below_limit") <= TAIL, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_said", judged).alias("verdict"), "below_limit")
