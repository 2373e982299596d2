"""Which short texts occur inside which longer ones, as equi-joins.

A LIKE '%x%' join would compare every pair.  Here every text offers the pieces
that start with the first letters of some pattern and have the length of such a
pattern, and pieces meet patterns by equality.  The result is exact.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.functions.compute import shuffled

HEAD = 3


def contained(texts: DataFrame, patterns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct (by..., text, pattern) with ``pattern`` a piece of ``text``.

    ``texts`` has the columns by + [text], ``patterns`` by + [pattern]; empty patterns are
    left out.  Both are made distinct first, so copies cost nothing.
    """
    by = by or []
    pats = patterns.select(*by, "pattern").filter(F.length("pattern") > 0).distinct()
    heads = (
        pats.select(*by, F.col("pattern").substr(1, HEAD).alias("head"), F.length("pattern").alias("size"))
        .groupBy(*by, "head")
        .agg(F.collect_set("size").alias("sizes"))
    )
    places = (
        texts.select(*by, "text").filter(F.length("text") > 0).distinct()
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("text"))))
    )
    starts = places.withColumn(
        "head",
        F.explode(F.array_distinct(F.array(*[F.col("text").substr(F.col("at"), F.lit(n)) for n in range(1, HEAD + 1)]))),
    )
    # three letters have few values, so all heads fit everywhere; with further keys they may be many
    heads = shuffled(heads) if by else F.broadcast(heads)
    pieces = (
        starts.join(heads, by + ["head"])
        .withColumn("size", F.explode("sizes"))
        .filter(F.col("at") + F.col("size") - 1 <= F.length("text"))
        .select(*by, "text", F.col("text").substr(F.col("at"), F.col("size")).alias("pattern"))
        .distinct()
    )
    return pieces.join(shuffled(pats), by + ["pattern"]).select(*by, "text", "pattern")
