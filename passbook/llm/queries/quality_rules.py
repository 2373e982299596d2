"""Quality verdicts on the documents table."""

from passbook.llm.common import table
from passbook.llm.quality_rules import quality
from passbook.plans.registry import register


@register("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
