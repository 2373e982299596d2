"""Documents that have a passage of the benchmark."""

from passbook.llm.common import table
from passbook.llm.decontaminate import contaminated
from passbook.plans.registry import register


@register("op3_decontamination")
def op3_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
