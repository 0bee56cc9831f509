"""URL judgement: explicit host/path rules, else empirical-Bayes reputation.

Labelled page outcomes (good or not) are counted per host. Each level shrinks
towards the one above it through a beta prior: global rate -> suffix ->
registered domain -> host. The prior strength of a level is the method of
moments estimate of its over-dispersion around the parent's posterior mean. A
host is blocked when the upper bound of its posterior rate (mean plus ``z``
standard deviations) stays below ``min_good``; hosts without own evidence
inherit their domain's, suffix's or the global posterior.

Defined cases: a NULL url and one without ``://`` have an empty host and path
and share one reputation; NULL outcomes and ids carry no evidence; a page
labelled several times counts once, by its worst outcome; repeated pages count
each; without labels every host has the uniform prior's posterior and is
allowed; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import settle

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels (fixed values; extend through the parameter).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")


@dataclass(frozen=True)
class Rule:
    action: str  # block or allow
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, NULL where none does."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def _levels(host: Column, two_label: Sequence[str]) -> tuple[Column, Column]:
    """Registered domain and suffix of a host (port and user dropped; an IPv4
    address is its own domain below the suffix ``ip``)."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    is_two = two.isin(list(two_label))
    ip = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    suffix = F.when(ip, F.lit("ip")).when(is_two, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(ip, bare).when(is_two, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(counts: DataFrame, least: float, most: float) -> float:
    """Prior strength of a level from (n, good, prior): Pearson's moment
    estimate of the intra-class correlation, kept within bounds."""
    noise = F.col("prior") * (1 - F.col("prior"))
    r = counts.agg(
        F.sum(F.pow(F.col("good") - F.col("n") * F.col("prior"), 2) - F.col("n") * noise).alias("extra"),
        F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("pairs"),
    ).first()
    if not r["pairs"]:
        return most
    rho = min(1 / (1 + least), max(1 / (1 + most), r["extra"] / r["pairs"]))
    return (1 - rho) / rho


def _posterior(counts: DataFrame, strength: float) -> DataFrame:
    mean = (F.lit(strength) * F.col("prior") + F.col("good")) / (F.lit(strength) + F.col("n"))
    return counts.withColumn("mean", mean)


def host_reputation(
    pages: DataFrame,
    outcomes: DataFrame,
    url: str = "url",
    key: str = "page_id",
    outcome_key: str = "page_id",
    good: str = "good",
    two_label_suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
    z: float = 1.6448536269514722,
    least: float = 1.0,
    most: float = 1e4,
) -> DataFrame:
    """(host, n, good, host_mean, host_upper) for every host of ``pages``."""
    seen = pages.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"))
    seen = seen.withColumn("host", F.coalesce("host", F.lit("")))
    worst = (
        outcomes.select(F.col(outcome_key).alias("id"), F.col(good).cast("int").alias("good"))
        .where("id IS NOT NULL AND good IS NOT NULL")
        .groupBy("id")
        .agg(F.min("good").alias("good"))
    )
    hosts = (
        seen.join(worst, "id", "left")
        .groupBy("host")
        .agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    )
    domain, suffix = _levels(F.col("host"), two_label_suffixes)
    hosts = settle(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = settle(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    rate = ((total["good"] or 0) + 1.0) / ((total["n"] or 0) + 2.0)

    suffixes = settle(suffixes.withColumn("prior", F.lit(rate)), "suffixes")
    suffixes = _posterior(suffixes, _strength(suffixes, least, most))
    domains = settle(domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix"), "domain-priors")
    domains = _posterior(domains, _strength(domains, least, most))
    hosts = settle(
        hosts.join(domains.select("suffix", "domain", F.col("mean").alias("prior")), ["suffix", "domain"]), "host-priors"
    )
    strength = _strength(hosts, least, most)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(strength) + F.col("n") + 1))
    scored = _posterior(hosts, strength).select(
        "host", "n", "good", F.col("mean").alias("host_mean"), (F.col("mean") + F.lit(z) * sd).alias("host_upper")
    )
    return settle(scored, "host-scores")


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    key: str = "page_id",
    min_good: float = 0.5,
    **reputation,
) -> DataFrame:
    """(key, host, path, rule, verdict, host_mean, host_upper) per page row.

    The reputation table is read back from files, so the join on the host is
    a broadcast when small and otherwise a shuffle whose hot hosts split."""
    scores = host_reputation(pages, outcomes, url, key, **reputation)
    scores = scores.select("host", "host_mean", "host_upper")
    seen = pages.select(
        F.col(key),
        F.coalesce(host_of(F.col(url)), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col(url)), F.lit("")).alias("path"),
    )
    name, action = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("host_upper") < min_good, "block").otherwise("allow")
    return seen.join(scores, "host", "left").select(
        key,
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(action, method).alias("verdict"),
        F.round("host_mean", 6).alias("host_mean"),
        F.round("host_upper", 6).alias("host_upper"),
    )
