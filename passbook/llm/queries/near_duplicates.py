"""Near duplicates among the documents."""

from passbook.llm.common import table
from passbook.llm.near_duplicates import near_duplicates
from passbook.plans.registry import register


@register("op6_near_duplicates")
def op6_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
