"""Token counts of the documents table."""

from passbook.llm.common import table
from passbook.llm.token_counts import token_counts
from passbook.plans.registry import register

PIECES = "piece_bpe_32k.model"


@register("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path(PIECES)))
