"""Small helpers the corpus operators share."""

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text contracts: space and \t \n \x0b \f \r.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(column, UPPER, LOWER)


def hidden(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with its columns out of the way as __0, __1, ..., and ``text`` once more as __in."""
    df = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    return df.withColumn("__in", F.col(f"__{docs.columns.index(text)}"))


def shown(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """The columns that ``hidden`` put away, under their own names; some with new values."""
    return df.select(*[replaced.get(c, F.col(f"__{i}")).alias(c) for i, c in enumerate(names)])


def row_names(key: str, text: str) -> list[Column]:
    """What names a row by its own text: the key and two hashes of the text."""
    return [F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``most`` bytes of ``text``, one row at least.

    Python's share of an executor's memory then follows the longest text, not the batch size.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + (size or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size or 0
        if start < len(sizes):
            yield batch.slice(start)


def two_sided(z):
    """Probability of a standard normal value at least as far out as ``z`` (Column)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # The rational approximation of erfc by Abramowitz and Stegun, 7.1.26.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


#: Rows a task takes where a stage's rows are known.
TASK_ROWS = 5000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than ``rows``, all that its last stage reads, ask for; never in more tasks than it has.

    Rounds over few rows then cost few tasks, whatever the number of shuffle partitions.
    """
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))
