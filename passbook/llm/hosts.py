"""URL filtering by host reputation, learned from labelled pages by empirical Bayes.

The share of bad pages of a suffix is shrunk towards the share over all pages, that of a
registered domain towards its suffix's, that of a host towards its domain's.  The strength of
each step is a beta prior's, fitted by moments to how much children of one parent differ.  A
host is blocked when the lower bound of its posterior bad share is above a threshold; a host
without labels is judged by its domain's posterior, else by its suffix's.
"""

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.llm.common import ascii_lower
from passbook.storage import cut

#: (verdict, host, path): a host suffix by whole labels, and the start of the path.
Rules = list[tuple[str, str, str]]


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """``df`` with host and path of the column ``url``; both empty without ``://``.

    The host ends before the first of ``/ ? #``, A-Z in lower case; the path is what follows
    up to ``?`` or ``#``.
    """
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = ascii_lower(F.regexp_extract(F.col("__rest"), r"^[^/?#]*", 0))
    path = F.regexp_extract(F.col("__rest"), r"^[^/?#]*([^?#]*)", 1)
    return df.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumns({"host": host, "path": path}).drop("__rest")


def rule_for(rules: Rules, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one.  The rules are a parameter."""
    name = verdict = F.lit(None).cast("string")
    for kind, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = (F.col(host) == domain) | F.endswith(F.col(host), F.lit("." + domain))
        fits &= F.startswith(F.col(path), F.lit(start))
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


#: An address of four numbers; its own domain, under the suffix "".
ADDRESS = r"^[0-9]+(?:[.][0-9]+){3}\z"


def with_levels(df: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """``df`` (host) with its registered domain and suffix.

    A suffix is the longest of ``suffixes`` (of several labels, like ``co.uk``) that the host lies
    under, else the last label; the domain is one label more.  A port does not count.  A host of
    one label is its own domain and suffix.
    """
    ends = "|".join([*(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)), "[^.]*"])
    bare = F.regexp_replace("host", r":[0-9]*\z", "")
    df = df.withColumn("domain", F.regexp_extract(bare, rf"{ADDRESS}|(?:[^.]*[.])?(?:{ends})\z", 0))
    above = F.regexp_replace("domain", r"^[^.]*[.]", "")
    return df.withColumn("suffix", F.when(F.col("domain").rlike(ADDRESS), "").otherwise(above))


MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def strength(groups: DataFrame, child: str, parent: str) -> float:
    """Rows a beta prior around the parent's share is worth, fitted by moments.

    With children of size n around their parent's share m, the excess of the squared distance
    over what binomial noise explains is m (1 - m) / (strength + 1) of n (n - 1).
    """
    by_child = groups.groupBy(child, parent).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_parent = groups.groupBy(parent).agg(F.sum("n").alias("pn"), F.sum("bad").alias("pbad"))
    m = F.col("pbad") / F.col("pn")
    noise = m * (1 - m)
    d = F.col("bad") - F.col("n") * m
    row = (
        by_child.join(by_parent, parent)
        .agg(
            F.sum(d * d - F.col("n") * noise).alias("excess"),
            F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("possible"),
        )
        .first()
    )
    if not row["possible"] or row["excess"] <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, row["possible"] / row["excess"] - 1))


def posteriors(labelled: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(level, name, mean, variance) of the posterior bad share of every host, domain and suffix in (host, bad) rows.

    Rows with a null ``host`` or ``bad`` do not count.  Partial sums go first, so a host with very
    many rows is one row per task.  Four single rows reach the driver: the overall share and the
    strengths of the three steps.
    """
    groups = labelled.filter("host IS NOT NULL AND bad IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad")
    )
    groups = cut(with_levels(groups, suffixes).withColumn("top", F.lit("")))
    total = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    prior = total["bad"] / total["n"] if total["n"] else 0.0
    steps = [("suffix", "top"), ("domain", "suffix"), ("host", "domain")]
    above, every = F.lit(prior), []
    shares = None
    for child, parent in steps:
        k = strength(groups, child, parent)
        own = groups.groupBy(child, parent).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if shares is not None:
            own = own.join(shares, parent)
            above = F.col("above")
        mean = (F.col("bad") + k * above) / (F.col("n") + k)
        level = own.select(F.col(child).alias("name"), mean.alias("mean"), (F.col("n") + k).alias("weight"))
        shares = level.select(F.col("name").alias(child), F.col("mean").alias("above"))
        variance = F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)
        every.append(level.select(F.lit(child).alias("level"), "name", "mean", variance.alias("variance")))
    return reduce(DataFrame.union, every)


def reputations(labelled: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """(host, mean, variance) of the posterior bad share of every host with labels."""
    hosts = posteriors(labelled, suffixes).filter("level = 'host'")
    return hosts.select(F.col("name").alias("host"), "mean", "variance")


def judge(
    pages: DataFrame,
    labelled: DataFrame,
    rules: Rules,
    url: str = "url",
    threshold: float = 0.5,
    z: float = 1.645,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block).

    ``labelled``: (host, bad) of pages whose outcome is known.  The rule decides where one
    fits; elsewhere a host is blocked if mean - z * deviation of its posterior bad share is
    above ``threshold``.  A host without labelled pages is judged by its domain's posterior,
    without that by its suffix's, and allowed where nothing is known; so is the empty host of a
    null or odd URL.  Rows are kept one by one.  Columns of ``pages`` named host, path, rule or
    verdict are replaced.
    """
    bad = F.col("mean") - z * F.sqrt("variance") > threshold
    known = cut(posteriors(labelled, suffixes).select("level", "name", bad.alias("bad")))
    own = pages.select(F.col(url).alias("__url"))
    asked = with_levels(with_parts(own, "__url").filter("host <> ''").select("host").distinct(), suffixes)
    for level in ("host", "domain", "suffix"):
        one = known.filter(F.col("level") == level).select(F.col("name").alias(level), F.col("bad").alias(f"__{level}"))
        asked = asked.join(one, level, "left")
    blocked = cut(asked.filter(F.coalesce("__host", "__domain", "__suffix")).select("host"))
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    name, verdict = rule_for(rules)
    parts = with_parts(pages.select(F.col(url).alias("__url"), *kept), "__url")
    joined = parts.join(blocked.withColumn("__bad", F.lit(True)), "host", "left")
    return joined.select(
        *kept,
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, F.when(F.col("__bad"), "block").otherwise("allow")).alias("verdict"),
    )
