"""Importance resampling towards a target corpus, ranked by a distributed radix sort.

Words are hashed into a fixed number of buckets.  A bucket's gain is the logarithm of its share
in the target over its share in the raw documents; a document's weight is the sum of its words'
gains, looked up in one array.  A hash of the key adds Gumbel noise, so that the highest scores
are a weighted draw without replacement.

The ranks come from a least-significant-digit radix sort.  The composite key (score, document
key, number of words) is cut into digits, of which only bits that differ between rows count.  In
every pass a block of rows, which its task holds in order, finds each row's rank among the
block's rows of the same digit; counts per block and digit give the blocks' global offsets, and
offset + rank is the row's destination.  Blocks are stretches of destinations, so all are of one
size however many rows share a digit, a score or a key.  Every pass is written to the shared
folder; a lost executor costs the tasks of one pass.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from passbook.llm.common import slices
from passbook.storage import cut

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
SLICE_BYTES = 2_000_000
#: Bits of a digit, and rows of a block: the table of offsets has at most a sixteenth of the rows.
DIGIT, BLOCK = 12, 1 << 16

#: Bytes to bytes: A-Z in lower case, what is in no word to a space.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def features(text: str | None, most: int = 1) -> tuple[int, list[bytes]]:
    """Number of words, and all runs of 1 to ``most`` of them; a word has digits, letters a-z and all beyond ASCII."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    longer = [b" ".join(words[i : i + n]) for n in range(2, most + 1) for i in range(len(words) - n + 1)]
    return len(words), words + longer


def hashed(docs: DataFrame, key: str, text: str, most: int, buckets: int) -> DataFrame:
    """(key, n_words, n_features, held) of every row; ``held``: the features' buckets as 32-bit numbers."""
    full = StructType([docs.schema[key], *StructType.fromDDL("n_words bigint, n_features bigint, held binary").fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            n_words, n_features, held = [], [], []
            for value in batch.column(text).to_pylist():
                n, found = features(value, most)
                n_words.append(n)
                n_features.append(len(found))
                held.append((np.array(list(map(zlib.crc32, found)), dtype=np.uint32) % np.uint32(buckets)).tobytes())
            arrays = [pa.array(c, f.type) for c, f in zip([n_words, n_features, held], list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(arrow.field(0).type), *arrays], schema=arrow)

    return docs.select(key, text).mapInArrow(run, full)


def counted(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket over all rows; one number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            held = b"".join(batch.column("held").to_pylist())
            total += np.bincount(np.frombuffer(held, np.uint32), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    per_task = rows.select("held").mapInArrow(run, "bucket bigint, n bigint")
    for row in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        counts[row["bucket"]] = row["n"]
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in ``target`` over that in ``raw``, per bucket."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    pairs = zip(target.tolist(), raw.tolist(), strict=True)
    return np.array(
        [math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)))) for t, s in pairs], dtype=np.int64
    )


def weighted(rows: DataFrame, key: str, gain: np.ndarray, min_words: int) -> DataFrame:
    """(key, n_features, weight, block, place): rows of ``min_words`` words on are numbered, by blocks of their task."""
    full = StructType([rows.schema[key], *StructType.fromDDL("n_features bigint, weight bigint, block bigint, place bigint").fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = [int(gain[np.frombuffer(h, np.uint32)].sum()) for h in batch.column("held").to_pylist()]
            enough = batch.column("n_words").to_numpy() >= min_words
            number = seen + np.cumsum(enough) - 1
            seen += int(enough.sum())
            block, place = (task << 32) + number // BLOCK, number % BLOCK
            arrays = [pa.array(weight, pa.int64()), pa.array(block, mask=~enough), pa.array(place, mask=~enough)]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(arrow.field(0).type), batch.column("n_features"), *arrays], schema=arrow)

    return rows.mapInArrow(run, full)


def digits(parts: list[tuple[Column, int]]) -> list[Column]:
    """The digits of a composite key, lowest first; ``parts``: (value, low bits that count), lowest first."""
    out, width = [], sum(bits for _, bits in parts)
    for low in range(0, width, DIGIT):
        digit, at = F.lit(0).cast("bigint"), 0
        for value, bits in parts:
            if at < low + DIGIT and at + bits > low:
                kept = value if bits > 63 else value.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
                moved = F.shiftrightunsigned(kept, low - at) if at < low else F.shiftleft(kept, at - low)
                digit = digit.bitwiseOR(moved)
            at += bits
        out.append(digit.bitwiseAND(F.lit((1 << DIGIT) - 1).cast("bigint")))
    return out


def differing(rows: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    """Per column the number of low bits beyond which all rows agree: one row reaches the driver."""
    ored = [F.bit_or(c).alias(f"{n}_or") for n, c in columns.items()]
    anded = [F.bit_and(c).alias(f"{n}_and") for n, c in columns.items()]
    row = rows.agg(*ored, *anded).first()
    return {n: (((row[f"{n}_or"] or 0) ^ (row[f"{n}_and"] or 0)) & ((1 << 64) - 1)).bit_length() for n in columns}


def counting_pass(state: DataFrame, digit: Column) -> DataFrame:
    """``state`` with ``to``: every row's place after one stable pass over ``digit``.

    ``state`` has block and place, unique within the block and below BLOCK.
    """
    given = state.withColumn("digit", digit)
    full = StructType([*given.schema.fields, *StructType.fromDDL("r bigint").fields])
    arrow = to_arrow_schema(full)

    def run(block: pa.Table) -> pa.Table:  # at most BLOCK rows
        place = block.column("place").to_numpy()
        at = np.full(BLOCK, -1, dtype=np.int64)
        at[place] = np.arange(len(place))
        at = at[at >= 0]
        by_place = block.column("digit").to_numpy()[at].astype(np.uint16)
        order = np.argsort(by_place, kind="stable")  # a counting sort for 16-bit numbers
        counts = np.bincount(by_place, minlength=1 << DIGIT)
        rank = np.empty(len(place), dtype=np.int64)
        rank[at[order]] = np.arange(len(place)) - np.repeat(np.cumsum(counts) - counts, counts)
        return block.append_column("r", pa.array(rank)).cast(arrow)

    ranked = cut(given.groupBy("block").applyInArrow(run, full))
    counts = cut(ranked.groupBy("block", "digit").agg((F.max("r") + 1).alias("n")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per digit
    firsts = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", before(Window.orderBy("digit")).alias("first"))
    own = counts.withColumn("before", before(Window.partitionBy("digit").orderBy("block")))
    offsets = own.join(firsts, "digit").select("block", "digit", (F.col("first") + F.col("before")).alias("offset"))
    placed = ranked.join(offsets, ["block", "digit"])
    return placed.withColumn("to", F.col("offset") + F.col("r")).select(*state.columns, "to")


def radix_ranks(rows: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """``rows`` (with block and place) and ``rank`` 1, 2, 3, ... in the order of ``parts``, least significant first.

    The parts are 64-bit numbers, compared by the bits that differ between rows; a part whose
    sign differs is compared as an unsigned number, so its caller flips the sign bit.
    """
    widths = differing(rows, parts)
    state = rows
    for digit in digits([(parts[n], widths[n]) for n in parts]) or [F.lit(0).cast("bigint")]:
        moved = counting_pass(state, digit)
        state = moved.withColumns({"block": F.expr(f"`to` div {BLOCK}"), "place": F.expr(f"`to` % {BLOCK}")}).select(rows.columns)
    return state.withColumn("rank", F.col("block") * BLOCK + F.col("place") + 1).drop("block", "place")


def unsigned(value: Column) -> Column:
    """Numbers whose unsigned order is the signed order of ``value``."""
    return value.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    most: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with ``min_words`` words or more, the ``percent`` % of the highest scores
    (rounded down) are drawn and have a rank, ties to the smaller key; all others' is null.
    Features are all runs of 1 to ``most`` words.  A null or empty text has no features and
    weight 0.  ``key`` is a whole number; a null key draws its noise from the seed alone and
    sorts behind equal scores of other keys.  Rows of one key are ranked one by one, fewer features
    first.  Empty tables give no rows, or gains against nothing.  Other columns are left out.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number")
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    aim = target.select(F.lit(0).alias("key"), F.col(target_text).alias("text"))
    rows = cut(hashed(own, "key", "text", most, buckets))
    gain = gains(counted(rows, buckets), counted(hashed(aim, "key", "text", most, buckets), buckets))

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    gumbel = F.floor(-1000 * F.log(-F.log((noise.cast("double") + 0.5) / 4294967296.0)))
    scored = cut(weighted(rows, "key", gain, min_words).withColumn("score", F.col("weight") + gumbel))
    sized = scored.filter("block IS NOT NULL")
    ranked = radix_ranks(
        sized,
        {
            "n_features": F.col("n_features"),
            "key": unsigned(F.coalesce(F.col("key").cast("bigint"), F.lit(0))),
            "none": F.col("key").isNull().cast("bigint"),
            "score": F.bitwise_not(unsigned(F.col("score"))),
        },
    )
    drawn = sized.count() * percent // 100
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter("block IS NULL").drop("block", "place").withColumn("rank", F.lit(None).cast("bigint"))
    columns = [F.col("key").alias(key), "n_features", "weight", "score", "rank"]
    return ranked.withColumn("rank", rank).unionByName(rest).select(*columns)
