"""Bytes covered by a long string that also starts elsewhere, by bucket refinement.

Which strings of LENGTH bytes come twice is decided without sorting all suffixes.  Every
string has an anchor, the place of its smallest hash of GRAM bytes; equal strings have it at
the same offset.  Anchors are the suffixes that are sorted into buckets, and a bucket's number
is refined by what stands at further offsets, coarse steps first:

1. by the GRAM bytes at the anchor: no string of an anchor alone in its bucket is repeated;
2. by all bytes any string of the anchor can have: those of a shared bucket are all repeated;
3. by the bytes common to, and the bytes spanned by, sixteen neighbouring offsets;
4. by whole strings, one offset at a time, where step 3 left it open.

Each step only looks at what the step before left undecided, and takes the bucket numbers from
there.  Buckets are counted with partial sums, never gathered, so a passage that a third of
all documents share is a handful of rows per task.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passbook.llm.common import slices
from passbook.storage import cut

LENGTH = 400
#: Offsets an anchor can have in its strings; a power of STEP.
OFFSETS, STEP = 256, 16
GRAM = LENGTH - OFFSETS + 1
BLOCK = 1 << 20
SLICE_BYTES = 2_000_000

_random = np.random.default_rng(20240301)
BYTES = _random.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


_TABLES: dict[str, list[np.ndarray]] = {}


def tables(n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Powers of the bases and of their inverses, at least ``n`` of each, kept per worker."""
    if not _TABLES or len(_TABLES["up"][0]) < n:
        n = 1 << (n - 1).bit_length()
        _TABLES["up"] = [_powers(b, n) for b in BASES]
        _TABLES["down"] = [_powers(pow(b, -1, 1 << 64), n) for b in BASES]
    return _TABLES["up"], _TABLES["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """64-bit hashes of any stretch of some bytes, in constant time each."""

    def __init__(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)):
        up, self.down = tables(len(data) + 1)
        self.sums = {}
        for w in which:
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum(BYTES[w][data] * up[w][: len(data)], out=sums[1:])
            self.sums[w] = sums

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums[which]
        return mixed((sums[ends] - sums[starts]) * self.down[which][starts] + (ends - starts).astype(np.uint64))


def anchors_of(pieces: list[tuple[np.ndarray, int, int]]) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first, last, gram hash) of the runs of strings that have one anchor.

    ``pieces``: bytes, and the range of string starts to look at; offsets are within a piece.
    """
    data = np.concatenate([p for p, _, _ in pieces])
    n = len(data)
    base = np.cumsum([0, *(len(p) for p, _, _ in pieces)])
    hashes = Hashes(data, (0,))
    at = np.arange(n - GRAM + 1)
    grams = hashes.of(at, at + GRAM)
    bits = np.uint64((1 << int(n).bit_length()) - 1)
    least = (grams & ~bits) | at.astype(np.uint64)  # equal hashes: the leftmost
    width = 1
    while width < OFFSETS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    starts = np.concatenate([np.arange(base[i] + lo, base[i] + hi) for i, (_, lo, hi) in enumerate(pieces)])
    anchor = (least[starts] & bits).astype(np.int64)
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    a = anchor[first]
    piece = np.searchsorted(base, a, side="right") - 1
    return piece, a - base[piece], starts[first] - base[piece], starts[last] - base[piece], grams[a].astype(np.int64)


TEXT = "t1 bigint, t2 bigint, "


def arrow_map(df: DataFrame, columns: str, run: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    """Rows (t1, t2, columns) from ``run(batch)``, which gives lists of columns."""
    schema = StructType.fromDDL(TEXT + columns)
    arrow = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            for out in run(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(each, schema)


def anchors(texts: DataFrame) -> DataFrame:
    """(t1, t2, a, s, e, h): anchor, first and last start of its strings, hash of its gram."""

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        t1, t2 = batch.column("t1").to_numpy(), batch.column("t2").to_numpy()
        rows, offsets, pieces, size = [], [], [], 0

        def flush():
            piece, a, s, e, h = anchors_of(pieces)
            row, off = np.array(rows)[piece], np.array(offsets)[piece]
            return [t1[row], t2[row], a + off, s + off, e + off, h]

        for row, value in enumerate(batch.column("text").to_pylist()):
            data = np.frombuffer(value, dtype=np.uint8)
            strings = len(data) - LENGTH + 1
            for lo in range(0, strings, BLOCK):
                hi = min(strings, lo + BLOCK)
                piece = data[lo : hi + LENGTH - 1]
                rows.append(row)
                offsets.append(lo)
                pieces.append((piece, 0, hi - lo))
                size += len(piece)
                if size > BLOCK:
                    yield flush()
                    rows, offsets, pieces, size = [], [], [], 0
        if pieces:
            yield flush()

    return arrow_map(texts, "a bigint, s bigint, e bigint, h bigint", run)


def listed(wanted: DataFrame) -> DataFrame:
    """(t1, t2, anchors): the anchors ``wanted`` (t1, t2, a, s, e, k) of each text."""
    return wanted.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("a", "s", "e", "k"))).alias("anchors"))


def per_anchor(texts: DataFrame, columns: str, of) -> DataFrame:
    """Rows from ``of(hashes, n, off, a, s, e, k)`` for the anchors (a, s, e, k) of ``texts`` (t1, t2, text, anchors).

    ``k`` is what the step before found: the bucket, or the group of offsets.
    ``hashes`` covers the text from ``off`` on; ``n`` is the text's length.  ``of`` gives the
    number of the anchor each row comes from, and the columns.
    """

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        for t1, t2, text, listed in zip(*(batch.column(c) for c in ("t1", "t2", "text", "anchors")), strict=True):
            data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            a, s, e, k = (np.asarray(c) for c in listed.values.flatten())
            for lo in range(0, len(data), BLOCK):
                use = (a >= lo) & (a < lo + BLOCK)
                if not use.any():
                    continue
                off = max(0, lo - OFFSETS)
                hashes = Hashes(data[off : lo + BLOCK + LENGTH + OFFSETS])
                which, out = of(hashes, len(data), off, a[use], s[use], e[use], k[use])
                yield [np.full(len(which), t1.as_py()), np.full(len(which), t2.as_py()), *out]

    return arrow_map(texts, columns, run)


def _pair(hashes: Hashes, off: int, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> list[pa.Array]:
    """Two hashes of each stretch, null where it isn't inside the text."""
    starts, ends = np.where(inside, starts - off, 0), np.where(inside, ends - off, 0)
    return [pa.array(hashes.of(starts, ends, w).astype(np.int64), mask=~inside) for w in (0, 1)]


def whole_span(hashes, n, off, a, s, e, k):
    """Step 2: the bytes any string with this anchor can have."""
    starts, ends = a - OFFSETS + 1, a + LENGTH
    return a, [a, s, e, k, *_pair(hashes, off, starts, ends, (starts >= 0) & (ends <= n))]


def by_step(hashes, n, off, a, s, e, k):
    """Step 3: per group of STEP offsets, the bytes all its strings share, and those they span."""
    low, high = (a - e) // STEP, (a - s) // STEP
    count = high - low + 1
    which = np.repeat(np.arange(len(a)), count)
    group = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    a, s, e = a[which], s[which], e[which]
    nearest, farthest = group * STEP, group * STEP + STEP - 1
    core = hashes.of(a - nearest - off, a - farthest + LENGTH - off) + group.astype(np.uint64)
    starts, ends = a - farthest, a - nearest + LENGTH
    return a, [a, s, e, group, core.astype(np.int64), *_pair(hashes, off, starts, ends, (starts >= 0) & (ends <= n))]


def by_string(hashes, n, off, a, s, e, k):
    """Step 4: the strings of a group of offsets."""
    offset = k[:, None] * STEP + np.arange(STEP)
    start = a[:, None] - offset
    use = (start >= s[:, None]) & (start <= e[:, None])
    start = start[use]
    return start, [start, *(hashes.of(start - off, start + LENGTH - off, w).astype(np.int64) for w in (0, 1))]


def shared(rows: DataFrame, *by: str) -> DataFrame:
    """The values of ``by`` that two rows or more have."""
    some = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in by))
    return cut(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by))


def split(rows: DataFrame, bucket: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose span (c1, c2) comes twice, and those to refine.

    The latter are the others, and one of each kind of the former whose ``bucket`` some other
    shares: what is left open may be equal to a part of it.
    """
    both = shared(rows, "c1", "c2").withColumn("again", F.lit(True))
    known = cut(rows.join(both, ["c1", "c2"], "left"))
    settled = known.filter("again").drop("again")
    others = known.filter("again IS NULL").drop("again")
    kinds = ["c1", "c2", "k", F.expr("s - a").alias("before"), F.expr("e - a").alias("behind")]
    one = settled.groupBy(*kinds).agg(F.min(F.struct(*settled.columns)).alias("one")).select("one.*")
    open_buckets = cut(others.select(bucket).distinct())
    wanted = ["t1", "t2", "a", "s", "e", "k"]
    return settled, cut(others.select(wanted).union(cut(one).join(open_buckets, bucket, "left_semi").select(wanted)))


def covers(texts_of: Callable[[DataFrame], DataFrame], found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, start, end) of repeated stretches, and the texts that may have any."""
    # copies of one text have equal anchors: one of each stands for all; and where a long text
    # was cut into blocks, the strings of one anchor come together again
    left = found.join(shared(found, "h"), "h", "left_semi").groupBy("t1", "t2", "a", "h")
    left = cut(left.agg(F.min("s").alias("s"), F.max("e").alias("e")))
    left = cut(left.join(shared(left, "h"), "h", "left_semi"))
    # the anchors travel with the one join that moves all texts: step 2 needs none of its own
    asked = cut(texts_of(cut(listed(left.select("t1", "t2", "a", "s", "e", F.col("h").alias("k"))))))
    texts = asked.drop("anchors")

    def again_for(open_: DataFrame) -> DataFrame:
        return texts.join(cut(listed(open_)), ["t1", "t2"])

    spans = cut(per_anchor(asked, "a bigint, s bigint, e bigint, k bigint, c1 bigint, c2 bigint", whole_span))
    settled, open_ = split(spans, "k")
    done = [settled.selectExpr("t1", "t2", f"a - {OFFSETS - 1} AS start", f"a + {LENGTH} AS end")]

    columns = "a bigint, s bigint, e bigint, k bigint, g bigint, c1 bigint, c2 bigint"
    groups = cut(per_anchor(again_for(open_), columns, by_step))
    groups = cut(groups.join(shared(groups, "g"), "g", "left_semi"))
    settled, open_ = split(groups, "g")
    start, end = f"a - k * {STEP} - {STEP - 1} AS start", f"a - k * {STEP} + {LENGTH} AS end"
    done.append(settled.selectExpr("t1", "t2", start, end))

    strings = cut(per_anchor(again_for(open_), "p bigint, w1 bigint, w2 bigint", by_string))
    again = strings.join(shared(strings, "w1", "w2"), ["w1", "w2"], "left_semi")
    done.append(again.selectExpr("t1", "t2", "p AS start", f"p + {LENGTH} AS end"))
    return done[0].union(done[1]).union(done[2]), texts


def removed(texts: DataFrame, stretches: DataFrame) -> DataFrame:
    """(t1, t2, n_removed, n_spans, kept_sha256) of the texts that have a stretch."""
    grouped = cut(stretches.groupBy("t1", "t2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")))

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        out = []
        for t1, t2, text, listed in zip(*(batch.column(c) for c in ("t1", "t2", "text", "spans")), strict=True):
            data, kept, at, gone, runs = memoryview(text.as_buffer()), hashlib.sha256(), 0, 0, 0
            start, end = (np.asarray(c) for c in listed.values.flatten())
            for a, b in zip(start.tolist(), end.tolist(), strict=True):
                if a > at or runs == 0:  # spans that only touch are one run
                    kept.update(data[at:a])
                    runs, at = runs + 1, a
                gone += max(0, b - at)
                at = max(at, b)
            kept.update(data[at:])
            out.append((t1.as_py(), t2.as_py(), gone, runs, kept.hexdigest()))
        yield list(zip(*out, strict=True))

    return arrow_map(texts.join(grouped, ["t1", "t2"]), "n_removed bigint, n_spans bigint, kept_sha256 string", run)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, t1, t2, text): the text as UTF-8 bytes, and two hashes that name it."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("__key"), F.xxhash64(value).alias("t1"), F.xxhash64(F.lit(7), value).alias("t2"), value.cast("binary").alias("text")
    )


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a string of LENGTH bytes over it also starts anywhere else, in the same text
    or another row's.  Rows with equal texts are copies of each other: from LENGTH bytes on
    nothing of them stays.  A null text is empty.  Null and repeated keys are rows like others;
    other columns are left out.
    """
    own = keyed(docs, key, text)
    rows = cut(own.select("__key", "t1", "t2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    names = cut(rows.groupBy("t1", "t2").agg(F.min("__key").alias("one"), F.count(F.lit(1)).alias("copies")))
    long = own.filter(F.octet_length("text") >= LENGTH)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """``wanted`` (t1, t2, anchors) with the text: one row per text, but for rows with equal keys too, which the counts don't mind."""
        one = cut(names.join(wanted, ["t1", "t2"]).select("t1", "t2", "one", "anchors"))
        same = (long["t1"] == one["t1"]) & (long["t2"] == one["t2"]) & long["__key"].eqNullSafe(one["one"])
        return long.join(one, same).select(long["t1"], long["t2"], "text", "anchors")

    stretches, texts = covers(texts_of, cut(anchors(long.select("t1", "t2", "text"))))
    copied = cut(names.filter("copies > 1").select("t1", "t2", F.lit(True).alias("copied")))
    # copies go whole, so only texts that exist once need their stretches
    part = cut(removed(texts.join(copied, ["t1", "t2"], "left_anti"), stretches))
    joined = rows.join(copied, ["t1", "t2"], "left").join(part, ["t1", "t2"], "left")
    gone = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    nothing = hashlib.sha256(b"").hexdigest()

    def pick(whole: Column, some: str, none: Column) -> Column:
        return F.when(gone, whole).otherwise(F.coalesce(F.col(some), none))

    return joined.select(
        F.col("__key").alias(key),
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        pick(F.lit(1).cast("bigint"), "n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        pick(F.lit(nothing), "kept_sha256", F.col("whole")).alias("kept_sha256"),
    )
