"""Documents as sets of shingles: hashes, nodes of equal sets, and the components of linked nodes."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passbook.llm.common import sized, slices
from passbook.llm.graph import components
from passbook.storage import cut

SLICE_BYTES = 2_000_000
#: Words whose hashes a Python worker remembers.
MEMO = 300_000
_WORDS: dict[bytes, int] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; A-Z in lower case, words by white space.

    Fewer words than a shingle has are one shingle; no words are none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > MEMO:
        _WORDS.clear()
    known = []
    for w in words:
        h = _WORDS.get(w)
        if h is None:
            h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
        known.append(h)
    hashes = np.array(known, dtype=np.uint64)
    each = min(len(hashes), size)
    n = len(hashes) - each + 1
    places = np.random.default_rng(size).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(n, each, dtype=np.uint64)
    for j in range(each):
        total += hashes[j : j + n] * places[j]
    return np.unique(mixed(total))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """The two 64-bit numbers that name a set."""
    return tuple(np.frombuffer(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), np.int64).tolist())


def mapped(df: DataFrame, key: str, text: str, schema: str, of: Callable[[list], list]) -> DataFrame:
    """(key, columns of ``schema``) of every row; ``of(texts)`` gives a list per column."""
    full = StructType([df.schema[key], *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            columns = of(batch.column(text).to_pylist())
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(arrow.field(0).type), *arrays], schema=arrow)

    return df.select(key, text).mapInArrow(run, full)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(s1, s2, key, node) per distinct set of ``rows`` (row, key, n, s1, s2): its smallest key, and that row's number."""
    known = rows.filter("n > 0 AND key IS NOT NULL")
    first = known.groupBy("s1", "s2").agg(F.min(F.struct("key", F.col("row").alias("node"))).alias("first"))
    return cut(first.select("s1", "s2", "first.key", "first.node"))


def hashes_of(own: DataFrame, nodes: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node), from the texts ``own`` (key, text); a repeated row may repeat its node."""
    named = nodes.join(wanted, "node", "left_semi").select("key", F.struct("node", "s1", "s2").alias("name"))

    def of(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, size) for t in texts]
        names = [digest(s) for s in sets]
        return [[n[0] for n in names], [n[1] for n in names], [s.astype(np.int64) for s in sets]]

    found = mapped(own.join(named, "key"), "name", "text", "s1 bigint, s2 bigint, hashes array<bigint>", of)
    # a key may have other texts too
    return found.filter("name.s1 = s1 AND name.s2 = s2").select("name.node", "hashes")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """The distinct pairs (a, b) with 100 * intersection >= ``percent`` * union, by the full sets (node, hashes).

    ``rows``: rows of ``pairs`` and ``sets``, by which the tasks are sized.
    """
    first = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    joined = sized(sized(pairs.select("a", "b").join(first, "a"), rows).join(second, "b"), rows)
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = F.size(F.array_intersect("x", "y"))
    similar = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return cut(sized(joined.filter(100 * small >= percent * large).filter(similar).select("a", "b").distinct(), rows))


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet, with their labels la and lb."""
    x = labels.select(F.col("a"), F.col("b").alias("la"))
    y = labels.select(F.col("a").alias("b"), F.col("b").alias("lb"))
    named = pairs.join(x, "a", "left").join(y, "b", "left").withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")})
    return named.filter("la <> lb")


def document_components(rows: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, n, component) of every row; ``links`` (a, b) are between nodes.

    The component is the smallest key that links reach, or rows that share a key or a set.  Without
    a set, or without a key, a row's component is its key.
    """
    known = rows.filter("n > 0 AND key IS NOT NULL").select("key", "s1", "s2")
    repeated = known.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("key")
    # the sets of one key belong together
    several = known.join(cut(repeated), "key", "left_semi").join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    joined = several.groupBy("key").agg(F.min("node").alias("b"))
    own = several.join(joined, "key").select(F.col("node").alias("a"), "b")
    labels = components(links.union(own))
    root = nodes.join(labels.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    root = cut(root.select("s1", "s2", "key", F.coalesce("root", "node").alias("root")))
    least = root.groupBy("root").agg(F.min("key").alias("component"))
    named = root.join(least, "root").select("s1", "s2", "component")
    found = rows.select("key", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    return found.select("key", "n", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component"))
