"""Verdicts on the urls of the pages table."""

from pyspark.sql import functions as F

from passbook.llm.common import table
from passbook.llm.hosts import MAX_STRENGTH, MIN_STRENGTH, judge, with_parts
from passbook.plans.registry import register

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
THRESHOLD, Z = 0.35, 1.645

_STRENGTH = """
  {k} AS (
    SELECT CASE WHEN coalesce(possible, 0) = 0 OR excess <= 0 THEN {most}
                ELSE least({most}, greatest({least}, possible / excess - 1)) END AS k
    FROM (SELECT sum((c.bad - c.n * (p.bad / p.n)) ** 2 - c.n * (p.bad / p.n) * (1 - p.bad / p.n)) AS excess,
                 sum(c.n * (c.n - 1) * (p.bad / p.n) * (1 - p.bad / p.n)) AS possible
          FROM (SELECT {child}, {parent}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM grp GROUP BY ALL) c
          JOIN (SELECT {parent}, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM grp GROUP BY ALL) p USING ({parent})))"""


def _strength(name, child, parent):
    return _STRENGTH.format(k=name, child=child, parent=parent, least=MIN_STRENGTH, most=MAX_STRENGTH)


def _fits():
    cases = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    when = [f"WHEN (host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{s}') THEN '{{}}'" for _, d, s in cases]
    names = " ".join(w.format(d + s) for w, (_, d, s) in zip(when, cases, strict=True))
    kinds = " ".join(w.format(k) for w, (k, _, _) in zip(when, cases, strict=True))
    return f"CASE {names} END", f"CASE {kinds} END"


_DOMAIN = r"regexp_extract(regexp_replace(host, ':[0-9]*\z', ''), '^[0-9]+(?:[.][0-9]+){3}\z|(?:[^.]*[.])?[^.]*\z', 0)"
_SUFFIX = r"CASE WHEN regexp_matches(domain, '^[0-9]+(?:[.][0-9]+){3}\z') THEN '' ELSE regexp_replace(domain, '^[^.]*[.]', '') END"


def _above(level):
    """Whether the posterior bound of a level is above the threshold; null where the level has no row."""
    return f"({level}.m - {Z} * sqrt({level}.m * (1 - {level}.m) / ({level}.w + 1)) > {THRESHOLD})"


SQL = f"""
WITH parts AS (
    SELECT page_id, url, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path,
      translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
  known AS (
    SELECT host, (l.quality = 0 OR l.toxic = 1)::INT AS bad
    FROM parts JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT)),
  grp AS (
    SELECT host, domain, {_SUFFIX} AS suffix, '' AS top, n, bad
    FROM (SELECT host, {_DOMAIN} AS domain, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM known WHERE bad IS NOT NULL GROUP BY host)),
  {_strength("ks", "suffix", "top")}, {_strength("kd", "domain", "suffix")}, {_strength("kh", "host", "domain")},
  s AS (SELECT suffix, sum(n) + any_value(k) AS w, (sum(bad) + any_value(k) * (SELECT sum(bad) / sum(n) FROM grp)) / (sum(n) + any_value(k)) AS m
        FROM grp, ks GROUP BY suffix),
  d AS (SELECT domain, sum(n) + any_value(k) AS w, (sum(bad) + any_value(k) * any_value(s.m)) / (sum(n) + any_value(k)) AS m
        FROM grp JOIN s USING (suffix), kd GROUP BY domain),
  h AS (SELECT host, n + k AS w, (bad + k * d.m) / (n + k) AS m FROM grp JOIN d USING (domain), kh),
  asked AS (
    SELECT host, domain, {_SUFFIX} AS suffix
    FROM (SELECT DISTINCT host, {_DOMAIN} AS domain FROM parts WHERE host <> '')),
  bad_hosts AS (
    SELECT host FROM asked LEFT JOIN h USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix)
    WHERE coalesce({_above("h")}, {_above("d")}, {_above("s")}))
SELECT page_id, host, path, {_fits()[0]} AS rule,
  coalesce({_fits()[1]}, CASE WHEN host IN (SELECT host FROM bad_hosts) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""


@register("op9_url_filter", SQL)
def op9_url_filter(spark, sf_dir):
    """A page's outcome is the label of the document its path names by number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    numbered = with_parts(pages, "url").select(
        "host", F.expr("try_cast(regexp_extract(path, '/([0-9]+)', 1) AS bigint)").alias("doc_id")
    )
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    labelled = numbered.join(labels.select("doc_id", bad), "doc_id").select("host", "bad")
    return judge(pages, labelled, RULES, threshold=THRESHOLD, z=Z).drop("url")
