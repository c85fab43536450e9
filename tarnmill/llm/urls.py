"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Pages that a rule judges are the labelled outcomes (other labels can be given). Their
success rates are shrunk level by level with beta-binomial priors: the suffix towards all
pages, the registered domain towards its suffix, the host towards its domain. How
strongly a level is shrunk follows from the spread of its rates (method of moments). A
page without a rule is blocked if the upper bound of its host's posterior lies below
``THRESHOLD``; hosts without outcomes inherit their domain's or suffix's mean.

Everything is DataFrame functions. Outcomes are summed per host before any exchange, and
pages meet only the blocked hosts, a join that adaptive execution can split at a hot host.

A null url, or one without ``://``, has an empty host and path. Null page ids and repeated
rows each keep a row. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.llm.common import staged

# Fixed values: (action, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# second labels that, before a two-letter country label, belong to the suffix
SECOND_LABELS = ["ac", "co", "com", "edu", "gov", "net", "org"]
THRESHOLD = 0.5
BOUND = 1.645
# the intra-class correlation of a level stays within these bounds
LEAST_RHO, MOST_RHO = 0.001, 0.999

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, action) of the longest rule that fits, or null."""
    chosen = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        chosen = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))).otherwise(chosen)
    return chosen


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix of a host, by a short rule, and the domain registered below it."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), r"\.", -1)
    n = F.size(labels)
    country = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(SECOND_LABELS)
    k = F.when(country, 2).otherwise(1)

    def last(count: Column) -> Column:
        count = F.least(count, n)
        return F.concat_ws(".", F.slice(labels, n - count + 1, count))

    return last(k), last(k + 1)


def strength(level: DataFrame) -> float:
    """Prior observations of a level: groups with n outcomes, ``good`` of them, below the
    mean ``prior``. Moment estimate of the beta-binomial's intra-class correlation."""
    spread = F.col("prior") * (1 - F.col("prior"))
    sums = level.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), F.lit(2.0)) - spread).alias("excess"), F.sum(spread * (F.col("n") - 1)).alias("scale")
    )
    excess, scale = sums.first()
    rho = excess / scale if scale else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def shrunk(level: DataFrame, s: float, mean: str) -> DataFrame:
    return level.withColumn(mean, (F.col("good") + s * F.col("prior")) / (F.col("n") + s))


def reputations(outcomes: DataFrame) -> DataFrame:
    """Per host of ``outcomes`` (host, labelled, good: long 0 or 1): mean and upper bound."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("labelled").alias("n"), F.sum("good").alias("good"))
    hosts = staged(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "good"), "hosts")
    good, n = hosts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]

    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit((good + 1) / (n + 2)))
    suffixes = shrunk(suffixes, strength(suffixes), "suffix_mean")
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes.select("suffix", F.col("suffix_mean").alias("prior")), "suffix")
    domains = shrunk(domains, strength(domains), "domain_mean")
    below = hosts.join(domains.select("suffix", "domain", F.col("domain_mean").alias("prior")), ["suffix", "domain"])
    s = strength(below)
    found = shrunk(below, s, "mean")
    error = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + s + 1))
    return found.select("host", "n", "good", "mean", (F.col("mean") + BOUND * error).alias("upper"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page (page_id, url): host, path, rule and verdict."""
    parts = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    judged = parts.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "found.rule", "found.action")
    outcomes = judged.select("host", F.col("action").isNotNull().cast("bigint").alias("labelled"), (F.coalesce("action", F.lit("")) == "allow").cast("bigint").alias("good"))
    blocked = reputations(outcomes).where(F.col("upper") < THRESHOLD).select("host", F.lit(True).alias("blocked"))
    met = judged.join(blocked, "host", "left")
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"))
