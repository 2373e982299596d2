"""Edit similarity of short texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, row by row of the usual table."""
    a_chars = F.filter(F.split(a, ""), lambda ch: ch != "")
    b_chars = F.filter(F.split(b, ""), lambda ch: ch != "")
    empty = F.array_repeat(F.lit(0), F.length(b) + 1)

    def next_row(previous: Column, ch: Column) -> Column:
        def cell(row: Column, j: Column) -> Column:
            match = F.get(b_chars, j) == ch
            best = F.when(match, F.get(previous, j) + 1).otherwise(
                F.greatest(F.get(previous, j + 1), F.get(row, j))
            )
            return F.concat(row, F.array(best))

        columns = F.sequence(F.lit(0), F.length(b) - 1)
        return F.aggregate(columns, F.array(F.lit(0)), cell)

    table = F.aggregate(a_chars, empty, next_row)
    return F.when((a == "") | (b == ""), 0).otherwise(F.get(table, F.length(b)))


def indel_ratio(a: Column, b: Column) -> Column:
    """Similarity 0..100: twice the common subsequence over both lengths."""
    return common_subsequence(a, b) * 200.0 / (F.length(a) + F.length(b))


def alike(a: Column, b: Column) -> Column:
    """Whether ``indel_ratio`` is at least 80, in whole numbers."""
    total = F.length(a) + F.length(b)
    return (total - 2 * common_subsequence(a, b)) * 5 <= total
