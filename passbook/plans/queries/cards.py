"""Card payment and seed queries."""

from pyspark.sql import functions as F

from passbook.operators import cards as cd
from passbook.plans.registry import register
from passbook.plans.testdata import categories, ledger, merchants, oracle, table
from passbook.sources import seed as sd

V1 = (
    "credit card payment|cc payment|hdfc.*credit card|icici.*credit card|sbi.*credit card|axis.*credit card|kotak.*credit card|"
    "credit card bill|cc bill payment|card payment|upi.*\\d{4}x+\\d{4}"
)
V2 = (
    "bppy cc payment|credit card payment|cc payment|hdfc.*credit card|icici.*credit card|axis.*credit card|credit card bill|"
    "billpay.*credit card|neft.*credit card|imps.*credit card"
)


def _hit(pattern):
    return (
        f"(regexp_matches(lower(original_description), '{pattern}') OR coalesce(regexp_matches(lower(cleaned_description), '{pattern}'), FALSE))"
    )


@register("card_payment_filter", oracle(f"SELECT id, {_hit(V1)} AS first_list, {_hit(V2)} AS second_list FROM ledger"))
def card_payment_filter(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "id",
        cd.is_card_payment(cd.CARD_PAYMENT_V1).alias("first_list"),
        cd.is_card_payment(cd.CARD_PAYMENT_V2).alias("second_list"),
    )


@register(
    "card_payment_reclass",
    oracle(
        f"""SELECT id, CASE WHEN hit THEN 'transfer' ELSE transaction_type END AS transaction_type,
      CASE WHEN hit THEN coalesce(notes || '; ', '') || 'Auto-detected as credit card payment' ELSE notes END AS notes
    FROM (SELECT *, transaction_type = 'expense' AND {_hit(V1)} AS hit FROM ledger)"""
    ),
)
def card_payment_reclass(spark, sf_dir):
    return cd.card_payment_reclass(ledger(spark, sf_dir)).select("id", "transaction_type", "notes")


HITS_SQL = f"""
hits AS (SELECT *, transaction_type = 'expense' AND NOT is_excluded AND {_hit(V2)} AS hit,
    CASE WHEN contains(lower(original_description), 'hdfc') THEN 'HDFC Credit Card' WHEN contains(lower(original_description), 'icici') THEN 'ICICI Credit Card'
      WHEN contains(lower(original_description), 'axis') THEN 'Axis Credit Card' WHEN contains(lower(original_description), 'sbi') THEN 'SBI Credit Card'
      ELSE 'Credit Card Payment' END AS card FROM ledger)"""


def _with_cards(spark, sf_dir):
    """The merchants and one of the card merchants the payments need."""
    known = merchants(spark, sf_dir)
    return known.withColumn("name", F.when(F.col("id") == 2, "Axis Credit Card").otherwise(F.col("name")))


@register(
    "card_payment_exclude",
    oracle(
        """SELECT id, is_excluded OR hit AS is_excluded, CASE WHEN hit THEN CASE WHEN card = 'Axis Credit Card' THEN 2 END ELSE merchant_id END AS merchant_id,
      CASE WHEN hit THEN 77 ELSE category_id END AS category_id, is_category_auto AND NOT hit AS is_category_auto,
      CASE WHEN hit THEN coalesce(notes || '; ', '') || 'Auto-detected as credit card payment (excluded from spending)' ELSE notes END AS notes FROM hits""",
        more=HITS_SQL,
    ),
)
def card_payment_exclude(spark, sf_dir):
    done = cd.card_payment_exclude(ledger(spark, sf_dir), _with_cards(spark, sf_dir), 77)
    return done.select("id", "is_excluded", "merchant_id", "category_id", "is_category_auto", "notes")


@register(
    "missing_card_merchants",
    oracle("SELECT DISTINCT card AS name FROM hits WHERE hit AND card <> 'Axis Credit Card'", more=HITS_SQL),
)
def missing_card_merchants(spark, sf_dir):
    return cd.missing_card_merchants(ledger(spark, sf_dir), _with_cards(spark, sf_dir))


@register(
    "seed_dimension",
    oracle(
        """SELECT id, name, coalesce((SELECT min(c.id) FROM grown c WHERE c.name = w.parent_name), parent_id) AS parent_id FROM grown
    LEFT JOIN (SELECT s_name AS wanted_name, n_name AS parent_name FROM supplier JOIN nation ON n_nationkey = s_nationkey) w ON w.wanted_name = grown.name""",
        more="""
grown AS (SELECT * FROM categories UNION ALL SELECT s_suppkey + 1000, s_name, NULL FROM supplier)""",
    ),
)
def seed_dimension(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    wanted = s.join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(
        (F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("parent_name")
    )
    known = n.select((F.col("n_nationkey") + 5000).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("parent_name"))
    return sd.seed_dimension(categories(spark, sf_dir), wanted.unionByName(known))
