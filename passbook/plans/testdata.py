"""The driver's tables seen as ledger tables.

Every view is a projection of whole tables.  ``LEDGER_SQL`` states the same
mapping once more in SQL for the oracle side.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.compute import shuffled

MONEY = "decimal(12,2)"
ROWS_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S17 load_table: one Parquet table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where a scan has fewer splits than cores.

    Parsing is work per row; a table in one row group would keep one core busy.  Scans with
    enough splits, as on a cluster, are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, to tasks that stay equally large however many rows there are.

    The splits of a scan are no measure: a file is cut by bytes, but its rows are in a few row
    groups, and most splits may hold none.  The count comes from the files' footers.
    """
    tasks = -(-df.count() // ROWS_A_TASK)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))


def ledger(spark: SparkSession, sf_dir: str, whole_units: bool = False) -> DataFrame:
    """Events as ledger rows; ``whole_units`` drops the cents so that amounts meet more often."""
    events = table(spark, sf_dir, "events")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    # every part is some row's text; the count comes from the file's footer
    e = events.join(shuffled(part), F.col("p_partkey") == F.col("event_id") % max(part.count(), 1))
    n = F.col("event_id")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    value = F.floor("value") if whole_units else F.col("value")
    name = F.upper("p_name")
    prefix = F.when(F.col("user_id") % 3 == 0, "UPI-").when(F.col("user_id") % 3 == 1, "NEFT-").otherwise("")
    text = (
        F.when(n % 31 == 0, F.concat(F.lit("Neft Credit  Card "), name))
        .when(n % 37 == 0, F.concat(F.lit("Axis bank credit card bill "), name))
        .when(n % 41 == 0, F.concat(F.lit("REFUND  "), name))
        .otherwise(F.concat(prefix, name))
    )
    kind = (
        F.when(F.col("event_type") == "view", "income")
        .when(F.col("event_type") == "error", "payment")
        .otherwise("expense")
    )
    source = (
        F.when(F.col("event_type") == "signup", "splitwise")
        .when(F.col("event_type").isin("purchase", "view"), "bank_csv")
        .when(F.col("event_type") == "click", "credit_card_pdf")
        .otherwise("bank_pdf")
    )
    closing = F.when(
        k % 10 == 0,
        F.when(k == 0, F.lit("0.00")).otherwise(F.concat((k / 10).cast("int").cast("string"), F.lit(",000.00"))),
    )
    metadata = F.concat(
        F.lit('{"raw":{"metadata":{"user_paid":'),
        F.when(n % 2 == 0, "true").otherwise("false"),
        F.coalesce(F.concat(F.lit(',"closing_balance":"'), closing, F.lit('"')), F.lit("")),
        F.lit("}}"),
        F.when(n % 3 == 0, ',"parser_metadata":{"bank":"acme","product":"credit_card"}').otherwise(""),
        F.lit("}"),
    )
    category = F.when(~(F.col("user_id") % 4).isin(0, 1), F.col("user_id") % 25 + 1)
    return e.select(
        n.alias("id"),
        F.col("user_id").alias("account"),
        source.alias("source_type"),
        n.alias("source_line_number"),
        F.when(k < 50, F.lpad(k.cast("string"), 6, "0")).alias("external_id"),
        F.col("ts").alias("transaction_date"),
        value.cast(MONEY).alias("amount"),
        F.when(n % 5 == 0, F.floor(F.col("value") / 2).cast(MONEY)).alias("effective_amount"),
        F.lit("INR").alias("currency"),
        kind.alias("transaction_type"),
        text.alias("original_description"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, F.lit(""))
        .otherwise(F.regexp_replace(text, " +", " ")).alias("cleaned_description"),
        F.when(F.col("user_id") % 4 != 0, F.col("user_id") % 10 + 1).alias("merchant_id"),
        category.alias("category_id"),
        (n % 10 != 0).alias("is_category_auto"),
        F.when(category.isNotNull() & (n % 6 != 0), n % 6).alias("applied_rule_id"),
        ((source == "splitwise") & (n % 3 == 0)).alias("is_payment"),
        (n % 23 == 0).alias("is_reconciled"),
        F.when(n % 23 == 0, n + 1).alias("reconciled_with_id"),
        (n % 17 == 0).alias("is_excluded"),
        F.when(n % 9 == 0, "checked").alias("notes"),
        metadata.alias("metadata_json"),
    )


def statement_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as ledger rows: several years of postings; (order, line) is not unique."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("transaction_date"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity").cast(MONEY)).alias("effective_amount"),
        F.when(F.col("l_returnflag") == "R", "income").when(F.col("l_returnflag") == "A", "payment")
        .otherwise("expense").alias("transaction_type"),
        (F.col("l_suppkey") + 1).alias("merchant_id"),
        (F.col("l_partkey") % 17 == 0).alias("is_excluded"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        (F.col("s_suppkey") + 1).alias("id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, "business").otherwise("person").alias("type"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") + 1).cast("long").alias("default_category_id"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 1).cast("long").alias("id"),
        F.col("n_name").alias("name"),
        (F.col("n_regionkey") + 101).cast("long").alias("parent_id"),
    )
    region = table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 101).cast("long").alias("id"),
        F.col("r_name").alias("name"),
        F.lit(None).cast("long").alias("parent_id"),
    )
    return nation.unionByName(region)


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as merchant aliases: the payee handle of a description is a piece of some alias."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") + 1).alias("id"),
        (F.col("p_partkey") % 10 + 1).alias("merchant_id"),
        F.concat(F.initcap("p_name"), F.lit(" Store "), F.col("p_partkey").cast("string")).alias("alias"),
    )


def _ledger_sql(value: str) -> str:
    return f"""
ledger0 AS (
  SELECT e.event_id AS n, e.user_id, e.ts, e.value, e.event_type, upper(p.p_name) AS nm,
         CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INT) AS k
  FROM events e JOIN part p ON p.p_partkey = e.event_id % (SELECT count(*) FROM part)),
ledger1 AS (
  SELECT *,
    CASE WHEN n % 31 = 0 THEN 'Neft Credit  Card ' || nm
         WHEN n % 37 = 0 THEN 'Axis bank credit card bill ' || nm
         WHEN n % 41 = 0 THEN 'REFUND  ' || nm
         ELSE CASE user_id % 3 WHEN 0 THEN 'UPI-' WHEN 1 THEN 'NEFT-' ELSE '' END || nm END AS txt,
    CASE event_type WHEN 'signup' THEN 'splitwise' WHEN 'purchase' THEN 'bank_csv' WHEN 'view' THEN 'bank_csv'
         WHEN 'click' THEN 'credit_card_pdf' ELSE 'bank_pdf' END AS src,
    CASE WHEN user_id % 4 NOT IN (0, 1) THEN user_id % 25 + 1 END AS cat,
    CASE WHEN k % 10 = 0 THEN CASE WHEN k = 0 THEN '0.00' ELSE CAST(k // 10 AS VARCHAR) || ',000.00' END END AS closing
  FROM ledger0),
ledger AS (
  SELECT n AS id, user_id AS account, src AS source_type, n AS source_line_number,
    CASE WHEN k < 50 THEN lpad(CAST(k AS VARCHAR), 6, '0') END AS external_id,
    ts AS transaction_date, CAST({value} AS DECIMAL(12,2)) AS amount,
    CASE WHEN n % 5 = 0 THEN CAST(floor(value / 2) AS DECIMAL(12,2)) END AS effective_amount,
    'INR' AS currency,
    CASE event_type WHEN 'view' THEN 'income' WHEN 'error' THEN 'payment' ELSE 'expense' END AS transaction_type,
    txt AS original_description,
    CASE WHEN n % 7 = 0 THEN NULL WHEN n % 7 = 1 THEN '' ELSE regexp_replace(txt, ' +', ' ', 'g') END AS cleaned_description,
    CASE WHEN user_id % 4 <> 0 THEN user_id % 10 + 1 END AS merchant_id, cat AS category_id,
    n % 10 <> 0 AS is_category_auto,
    CASE WHEN cat IS NOT NULL AND n % 6 <> 0 THEN n % 6 END AS applied_rule_id,
    src = 'splitwise' AND n % 3 = 0 AS is_payment, n % 23 = 0 AS is_reconciled,
    CASE WHEN n % 23 = 0 THEN n + 1 END AS reconciled_with_id, n % 17 = 0 AS is_excluded,
    CASE WHEN n % 9 = 0 THEN 'checked' END AS notes,
    '{{"raw":{{"metadata":{{"user_paid":' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END
      || coalesce(',"closing_balance":"' || closing || '"', '') || '}}}}'
      || CASE WHEN n % 3 = 0 THEN ',"parser_metadata":{{"bank":"acme","product":"credit_card"}}' ELSE '' END
      || '}}' AS metadata_json,
    k, closing, n % 2 = 0 AS user_paid
  FROM ledger1)"""


LEDGER_SQL = _ledger_sql("value")
LEDGER_WHOLE_SQL = _ledger_sql("floor(value)")

DIMENSIONS_SQL = """
merchants AS (
  SELECT s_suppkey + 1 AS id, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'business' ELSE 'person' END AS type,
         CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey + 1 AS BIGINT) END AS default_category_id FROM supplier),
categories AS (
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, CAST(n_regionkey + 101 AS BIGINT) AS parent_id FROM nation
  UNION ALL SELECT CAST(r_regionkey + 101 AS BIGINT), r_name, NULL FROM region),
aliases AS (
  SELECT p_partkey + 1 AS id, p_partkey % 10 + 1 AS merchant_id,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
           || ' Store ' || CAST(p_partkey AS VARCHAR) AS alias FROM part)"""


def oracle(body: str, whole_units: bool = False, more: str = "") -> str:
    """``WITH`` the ledger views (and further views) in front of ``body``."""
    base = LEDGER_WHOLE_SQL if whole_units else LEDGER_SQL
    extra = f",{more}" if more else ""
    return f"WITH RECURSIVE {base},{DIMENSIONS_SQL}{extra}\n{body}"


STATEMENT_SQL = """
ledger AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS transaction_date,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
    CASE WHEN l_linenumber = 1 THEN CAST(l_quantity AS DECIMAL(12,2)) END AS effective_amount,
    CASE l_returnflag WHEN 'R' THEN 'income' WHEN 'A' THEN 'payment' ELSE 'expense' END AS transaction_type,
    l_suppkey + 1 AS merchant_id, l_partkey % 17 = 0 AS is_excluded
  FROM lineitem)"""


def statement_oracle(body: str) -> str:
    """``WITH`` the order-line ledger in front of ``body``."""
    return f"WITH {STATEMENT_SQL}\n{body}"
