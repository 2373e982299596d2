"""Quality of every document, with its source as host and its language as path."""

from passbook.llm.common import table
from passbook.llm.quality_classifier import MAX_LABELLED, classify, sample, train
from passbook.plans.registry import register


@register("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    weights = train(sample(docs, labels, "quality", "doc_id", "text", MAX_LABELLED))
    return classify(docs, weights, ["source", "lang"])
