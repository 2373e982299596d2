"""Secrets in the documents table."""

from passbook.llm.common import table
from passbook.llm.secrets import scan
from passbook.plans.registry import register


@register("op1_secret_scan")
def op1_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
