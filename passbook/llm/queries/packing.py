"""The documents table packed into training sequences."""

from passbook.llm.common import table
from passbook.llm.packing import pack
from passbook.plans.registry import register

VOCABULARY = "byte_bpe_50k.json"


@register("op10_packing")
def op10_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path(VOCABULARY)))
