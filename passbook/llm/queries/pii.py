"""Personal data in the documents table."""

from passbook.llm.common import table
from passbook.llm.pii import scan
from passbook.plans.registry import register


@register("op7_personal_data")
def op7_personal_data(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
