"""Value lists and schemas of the ledger tables.

Timestamps are TIMESTAMP_NTZ: statement dates carry no zone, so no session
time zone may shift them.  Money is DECIMAL(12,2), always non-negative; the
sign lives in ``transaction_type``.
"""

from pyspark.sql import types as T

# The enum members stored in the ledger.
SOURCE_TYPES = ["splitwise", "bank_csv", "bank_pdf", "credit_card_pdf", "manual"]
TRANSACTION_TYPES = ["expense", "income", "transfer", "payment"]

MONEY = T.DecimalType(12, 2)

LEDGER = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("account", T.LongType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_line_number", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("transaction_date", T.TimestampNTZType()),
        T.StructField("amount", MONEY),
        T.StructField("effective_amount", MONEY),
        T.StructField("currency", T.StringType()),
        T.StructField("transaction_type", T.StringType()),
        T.StructField("original_description", T.StringType()),
        T.StructField("cleaned_description", T.StringType()),
        T.StructField("merchant_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("is_category_auto", T.BooleanType()),
        T.StructField("applied_rule_id", T.LongType()),
        T.StructField("is_payment", T.BooleanType()),
        T.StructField("is_reconciled", T.BooleanType()),
        T.StructField("reconciled_with_id", T.LongType()),
        T.StructField("is_excluded", T.BooleanType()),
        T.StructField("notes", T.StringType()),
        T.StructField("metadata_json", T.StringType()),
    ]
)

PERSON = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
    ]
)

SHARED_EXPENSE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("cost", T.StringType()),
        T.StructField("currency_code", T.StringType()),
        T.StructField("payment", T.BooleanType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("date", T.StringType()),
        T.StructField("deleted_at", T.StringType()),
        T.StructField(
            "category",
            T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())]),
        ),
        T.StructField("created_by", PERSON),
        T.StructField(
            "users",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("user", PERSON),
                        T.StructField("paid_share", T.StringType()),
                        T.StructField("owed_share", T.StringType()),
                        T.StructField("net_balance", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "repayments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("from", T.LongType()),
                        T.StructField("to", T.LongType()),
                        T.StructField("amount", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)

SHARED_BACKUP = T.StructType(
    [
        T.StructField("user", PERSON),
        T.StructField("friends", T.ArrayType(PERSON)),
        T.StructField(
            "groups",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("name", T.StringType()),
                        T.StructField("type", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("expenses", T.ArrayType(SHARED_EXPENSE)),
    ]
)
