"""Repeated passages of the documents table."""

from passbook.llm.common import table
from passbook.llm.repeated_passages import repeated_passages
from passbook.plans.registry import register


@register("op5_repeated_passages")
def op5_repeated_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))
