"""Connected components: alternating stars, and one task for what is left when that is few edges."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.storage import cut

#: Edges that one task takes in (16 bytes each).
AT_ONCE = 500_000


def _sum(edges: DataFrame):
    """A value that changes when the set of edges does."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _at_once(edges: DataFrame) -> DataFrame:
    """(a, b) of every node but the least of its component; ``edges`` are AT_ONCE at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if not read:
            return
        a, b = (np.concatenate(c) for c in zip(*read, strict=True))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
        while True:
            before = least.copy()
            low = np.minimum(least[x], least[y])
            for end in (least[x], least[y], x, y):  # the old representatives too
                np.minimum.at(least, end, low)
            least = least[least]
            if (least == before).all():
                break
        other = np.nonzero(least != np.arange(len(nodes)))[0]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[least[other]])], ["a", "b"])

    return edges.coalesce(1).mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(a, b): every node of ``links`` (a, b) but the smallest of its component, and that one.

    Large and small stars alternate until nothing changes, in about log(n) ** 2 rounds at
    worst, or until no more than AT_ONCE edges are left, which one task ends.  Minima are written
    before they are joined, so a node with very many neighbours is split over tasks.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    if edges.count() <= AT_ONCE:
        return cut(_at_once(edges))
    edges = cut(edges.distinct())
    before = _sum(edges)
    while before[0]:
        if before[0] <= AT_ONCE:
            return cut(_at_once(edges))
        both = edges.union(edges.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(moved.union(least).distinct())
        after = _sum(edges)
        if after == before:
            break
        before = after
    return edges
