"""Rule suggestion queries."""

from pyspark.sql import functions as F

from passbook.functions import text as t
from passbook.operators import suggest as sg
from passbook.plans.registry import register
from passbook.plans.testdata import ledger, oracle

TOKEN_SQL = """
described AS (SELECT *, coalesce(nullif(cleaned_description, ''), nullif(original_description, ''), '') AS descr FROM ledger),
worded AS (SELECT *, list_filter(string_split(regexp_replace(upper(descr), '^(UPI|IMPS|NEFT|RTGS|ACH)-', ''), ' '),
    lambda w: w <> '') AS ws FROM described),
tokened AS (SELECT *, coalesce(list_filter(ws, lambda w: length(w) > 3
    AND w NOT IN ('THE', 'AND', 'OR', 'TO', 'FROM', 'FOR', 'WITH'))[1], ws[1], '') AS token FROM worded)"""

GROUP_SQL = (
    TOKEN_SQL
    + """,
tok AS (SELECT * FROM tokened WHERE category_id IS NULL AND merchant_id IS NULL AND token <> '' AND token NOT IN
    ('TRANSFER','PAYMENT','CASH','DEBIT','CREDIT','REVERSAL','REFUND','SELF','MOBILE','ONLINE','INTEREST','BANK','CHARGES',
     'WITHDRAWAL','DEPOSIT','ATM') AND NOT regexp_matches(token, '^[0-9]+$')),
grp AS (
  SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS rk,
    coalesce(sum(amount) FILTER (transaction_type <> 'income'), 0) AS spent,
    coalesce(sum(amount) FILTER (transaction_type = 'income'), 0) AS received,
    min(transaction_date) AS earliest, max(transaction_date) AS latest
  FROM tok GROUP BY 1)"""
)

MERGE_SQL = (
    GROUP_SQL
    + """,
lcs(a, b, i, r) AS (
  SELECT x.token, y.token, 0, list_transform(range(0, length(y.token) + 1), lambda j: 0)
  FROM grp x JOIN grp y ON x.rk < y.rk
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: greatest(r[j],
    coalesce(list_max([r[p] + 1 for p in range(1, j) if b[p] = a[i + 1]]), 0)))
  FROM lcs WHERE i < length(a)),
edge AS (SELECT a AS before, b AS token FROM lcs
  WHERE i = length(a) AND (length(a) + length(b) - 2 * r[length(b) + 1]) * 5 <= length(a) + length(b)),
live(step, token, st) AS (
  SELECT 0, token, 0 FROM grp
  UNION ALL
  SELECT * FROM (
    SELECT s.step + 1, s.token, CASE WHEN s.st <> 0 THEN s.st WHEN bool_or(k.st = 1) THEN 2
      WHEN count(*) FILTER (k.st = 0) = 0 THEN 1 ELSE 0 END
    FROM live s LEFT JOIN edge e ON e.token = s.token LEFT JOIN live k ON k.token = e.before
    GROUP BY s.step, s.token, s.st) WHERE (SELECT count(*) FROM live WHERE st = 0) > 0),
final AS (SELECT token, st FROM live WHERE step = (SELECT max(step) FROM live)),
leaders AS (
  SELECT f.token, CASE WHEN f.st = 1 THEN f.token ELSE (SELECT arg_min(e.before, g.rk) FROM edge e JOIN final q ON q.token = e.before
      AND q.st = 1 JOIN grp g ON g.token = e.before WHERE e.token = f.token) END AS leader FROM final f),
stats AS (
  SELECT leader AS pattern, sum(n) AS transaction_count, CAST(sum(spent) - sum(received) AS DOUBLE) AS total_amount,
    CAST(sum(spent) + sum(received) AS DOUBLE) AS gross, min(earliest) AS earliest, max(latest) AS latest,
    min(rk) FILTER (g.token = leader) AS rk
  FROM grp g JOIN leaders l ON l.token = g.token GROUP BY 1 HAVING sum(n) >= 3)"""
)

STATS_COLUMNS = """pattern, CAST(transaction_count AS BIGINT) AS transaction_count, total_amount,
  total_amount / transaction_count AS avg_amount,
  strftime(earliest, '%Y-%m-%d') AS earliest, strftime(latest, '%Y-%m-%d') AS latest,
  CAST(transaction_count AS DOUBLE) * 0.6::DOUBLE + gross / 1000 * 0.4::DOUBLE AS score"""


@register("extract_pattern", oracle("SELECT id, token FROM tokened", more=TOKEN_SQL))
def extract_pattern(spark, sf_dir):
    text = t.first_nonempty(F.col("cleaned_description"), F.col("original_description"))
    return ledger(spark, sf_dir).select("id", t.merchant_token(text).alias("token"))


@register(
    "token_groups",
    oracle(
        """SELECT token, n, CAST(spent AS DOUBLE) AS spent, CAST(received AS DOUBLE) AS received FROM grp""",
        more=GROUP_SQL,
    ),
)
def token_groups(spark, sf_dir):
    groups = sg.token_groups(sg.tokens(ledger(spark, sf_dir)))
    return groups.select(
        "token", "n", F.col("spent").cast("double").alias("spent"), F.col("received").cast("double").alias("received")
    )


@register("token_merge", oracle("SELECT token, leader FROM leaders", more=MERGE_SQL))
def token_merge(spark, sf_dir):
    return sg.token_leaders(sg.token_groups(sg.tokens(ledger(spark, sf_dir))))


@register("suggestion_stats", oracle(f"SELECT {STATS_COLUMNS} FROM stats", more=MERGE_SQL))
def suggestion_stats(spark, sf_dir):
    return sg.suggestion_stats(ledger(spark, sf_dir)).drop("rank")


@register(
    "top_suggestions",
    oracle(
        f"""SELECT {STATS_COLUMNS}, (SELECT list_aggregate(list_sort(list({{'rk': rk, 'id': id, 'd': descr}}))[1:5], 'count')
        FROM (SELECT g.rk, min(t.id) AS id, t.descr FROM tok t JOIN leaders l ON l.token = t.token JOIN grp g ON g.token = t.token
              WHERE l.leader = stats.pattern GROUP BY g.rk, t.descr)) AS n_samples,
      (SELECT array_to_string(list_transform(list_sort(list({{'rk': rk, 'id': id, 'd': descr}}))[1:5], lambda s: s.d), '; ')
        FROM (SELECT g.rk, min(t.id) AS id, t.descr FROM tok t JOIN leaders l ON l.token = t.token JOIN grp g ON g.token = t.token
              WHERE l.leader = stats.pattern GROUP BY g.rk, t.descr)) AS samples
    FROM stats ORDER BY score DESC, transaction_count DESC, rk LIMIT 20""",
        more=MERGE_SQL,
    ),
)
def top_suggestions(spark, sf_dir):
    top = sg.suggestions(ledger(spark, sf_dir))
    return top.select(
        *[c for c in top.columns if c != "sample_descriptions"],
        F.size("sample_descriptions").cast("long").alias("n_samples"),
        F.array_join("sample_descriptions", "; ").alias("samples"),
    )


@register(
    "suggest_rule_for_tx",
    oracle(
        """SELECT id AS transaction_id, word AS suggested_pattern, merchant_id, would_affect
    FROM kw JOIN (SELECT word AS w, (SELECT count(*) FROM described d WHERE contains(upper(d.descr), q.word)) AS would_affect
      FROM (SELECT DISTINCT word FROM kw WHERE word IS NOT NULL) q) ON w = word
    WHERE would_affect >= 3""",
        more=TOKEN_SQL
        + """,
kw AS (SELECT id, merchant_id, list_filter(string_split(upper(descr), ' '), lambda w: length(w) > 3 AND w NOT IN
    ('UPI', 'IMPS', 'NEFT', 'RTGS', 'THE', 'AND', 'OR', 'TO', 'FROM', 'FOR', 'WITH'))[1] AS word
  FROM described WHERE merchant_id IS NOT NULL)""",
    ),
)
def suggest_rule_for_tx(spark, sf_dir):
    return sg.keyword_suggestions(ledger(spark, sf_dir))
