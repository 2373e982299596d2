"""Where an expression is worked out."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread_key(key: str, by: str = "id") -> Column:
    """A numeric key for a left join in which missing keys do not all meet in one task.

    Keys are compared as text; a missing one becomes a text that no number has.
    """
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("~"), F.hash(by).cast("string")))


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled, whatever its estimated size.

    Estimates follow the compressed files and see neither exploded rows nor built texts; a side
    taken for small would be broadcast, and a broadcast passes whole through the driver.
    """
    return df.hint("merge")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further (or replaced) columns that are worked out once per row.

    A filter on a projected column is normally moved below the projection and brings the
    whole expression with it, again for every use.  For parsing that repeats the costly part
    many times over; behind a generator of one row the filter stays where it is.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(packed)))
