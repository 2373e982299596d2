"""Packing token streams into sequences of a fixed window, with lengths fitted to the histogram.

Every document becomes its token ids and an end id.  Whole windows are cut off first; what
remains is a body, a multiple of ``UNIT`` tokens, and a tail shorter than that.  Bodies and
tails are packed alike, at two scales: shallow combinations of lengths that fill a window
exactly are enumerated, non-negative least squares says how often to repeat each so that the
histogram of lengths is used up, the counts are rounded, and what is left over is cut into
powers of two, which fill windows greedily without gaps.

Only the histograms (a few dozen lengths) reach the driver.  A piece finds its place from its
rank among the pieces of its length, which is the piece's number in its task plus the count
of the tasks before.
"""

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from passbook.llm.common import slices
from passbook.storage import cut

WINDOW, UNIT = 2048, 64
DEPTH = 3
SLICE_BYTES = 2_000_000
#: Stretches and pre-tokens kept per Python worker, and as many of the time before.
MEMO = 300_000
#: Piece kinds: whole windows, bodies (of UNIT tokens), tails (of single tokens).
FULL, BODY, TAIL = 0, 1, 2


class Spaced(Exception):
    """A space beside other white space: the pattern may reach over it."""


class Memo(dict):
    """Ids by text, from ``compute`` where unknown; after MEMO texts those not met again are forgotten."""

    def __init__(self, compute: Callable[[str], bytes]):
        self.compute, self.before = compute, {}

    def __missing__(self, text: str) -> bytes:
        if len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        found = self.before.get(text)
        if found is None:
            found = self.compute(text)
        self[text] = found
        return found


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, for byte-level BPE vocabularies.

    Between a letter and a space nothing in the pre-tokenizer's pattern reaches over, so a
    text falls into stretches at its spaces; what a stretch and what a pre-token became is
    remembered.  A text with other white space beside a space is split by the pattern as a
    whole; a text with a special token goes through the tokenizer's own pipeline, and so does
    every text of a file that normalises or splits texts in another way.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = re.compile("|".join(added) or r"(?!)") if plain_bytes(path) else re.compile("")
        self.split = regex.compile(PATTERN).findall
        self.model = self.tokenizer.model
        self.bytes = {b: c for c, b in zip(*byte_alphabet(), strict=True)}
        self.tokens, self.stretches = Memo(self.token), Memo(self.stretch)

    def token(self, token: str) -> bytes:
        """Ids of one pre-token."""
        if token.isascii() and token.isprintable():
            spelled = token.replace(" ", self.bytes[0x20])
        else:
            spelled = "".join([self.bytes[b] for b in token.encode()])
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def stretch(self, word: str) -> bytes:
        """Ids of a word and the space before it."""
        if word.isalpha():  # one pre-token
            return self.token(" " + word)
        if not word or word[0].isspace() or word[-1].isspace():
            raise Spaced
        return self.ids(" " + word)

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        if self.special.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *words = text.split(" ")
        if first[-1:].isspace():
            return self.ids(text)
        try:
            return self.ids(first) + b"".join(map(self.stretches.__getitem__, words))
        except Spaced:
            return self.ids(text)


#: Fixed value: the pattern byte-level BPE vocabularies split texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_bytes(path: str) -> bool:
    """Whether a tokenizer file is byte-level BPE that splits by PATTERN and changes no text before."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    first = spec.get("pre_tokenizer") or {}
    splits = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True)
    return splits and not spec.get("normalizer") and (spec.get("model") or {}).get("type") == "BPE"


def byte_alphabet() -> tuple[list[str], list[int]]:
    """The characters that stand for bytes, and the bytes: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) for b in plain] + [chr(256 + i) for i in range(len(others))], plain + others


#: Encoders of this Python worker, by file: its later tasks know the stretches of earlier ones.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def powers(n: int) -> list[int]:
    """The powers of two that make up ``n``, large ones first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


PIECES = (
    "kind int, size int, start bigint, length bigint, crc bigint, parts array<bigint>, "
    "doc_tokens bigint, task int, number bigint"
)


def pieces(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """(key, kind, size, start, length, crc, parts, doc_tokens, task, number) of every piece.

    ``parts``: checksums of the piece's powers of two, should it be cut up.  ``number`` counts
    the pieces of a kind and size within the task.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, numbers = encoder_of(path), {}
        task = TaskContext.get().partitionId()
        for batch in slices(batches, text, SLICE_BYTES):
            keys, out = batch.column(key).to_pylist(), []
            for name, value in zip(keys, batch.column(text).to_pylist(), strict=True):
                ids = encoder.encode(value or "") + end
                total = len(ids) // 4
                whole = total // WINDOW * WINDOW
                body = (total - whole) // UNIT
                tail_at = whole + body * UNIT
                spans = [(FULL, WINDOW, s, s + WINDOW, 1) for s in range(0, whole, WINDOW)]
                spans += [(BODY, body, whole, tail_at, UNIT)] * (body > 0)
                spans += [(TAIL, total - tail_at, tail_at, total, 1)] * (total > tail_at)
                for kind, size, a, b, unit in spans:
                    number = numbers.get((kind, size), 0)
                    numbers[kind, size] = number + 1
                    parts, at = [], a
                    for part in powers(size) if kind != FULL else []:
                        parts.append(zlib.crc32(ids[4 * at : 4 * (at + part * unit)]))
                        at += part * unit
                    out.append((name, kind, size, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), parts, total, task, number))
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    spark_schema = StructType([docs.schema[key], *StructType.fromDDL(PIECES).fields])
    schema = to_arrow_schema(spark_schema)
    return docs.select(key, text).mapInArrow(cut_pieces, spark_schema)


def combinations(full: int, depth: int) -> list[tuple[int, ...]]:
    """Up to ``depth`` lengths below ``full`` that add up to it, the longest first."""
    found = []
    for n in range(2, depth + 1):
        for head in combinations_with_replacement(range(full - 1, 0, -1), n - 1):
            last = full - sum(head)
            if 0 < last <= head[-1]:
                found.append((*head, last))
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Non-negative ``x`` with least squared ``a @ x - b``, by accelerated projected gradients."""
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def plan(histogram: dict[int, int], full: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats): the solution rounded down, then what else fits, greedily."""
    left = np.zeros(full, dtype=np.int64)
    for size, count in histogram.items():
        left[size] = count
    options = [c for c in combinations(full, depth) if all(left[s] for s in c)]
    if not options:
        return []
    use = np.zeros((full, len(options)), dtype=np.int64)
    for j, c in enumerate(options):
        for s in c:
            use[s, j] += 1
    scale = left.max()
    wanted = np.floor(nnls(use.astype(float), left / scale) * scale).astype(np.int64)
    repeats = np.zeros_like(wanted)
    order = np.argsort(-wanted, kind="stable")
    for most in (wanted, np.full_like(wanted, left.sum())):
        for j in order:
            n = min(most[j], *(left[s] // use[s, j] for s in options[j]))
            repeats[j] += n
            left -= use[:, j] * n
    return [(c, int(n)) for c, n in zip(options, repeats, strict=True) if n]


RULE = "kind int, size int, part int, lo bigint, hi bigint, base bigint, stride bigint, shift bigint, tokens bigint"


def rules_of(kind: int, histogram: dict[int, int], unit: int, full: int, at: int) -> tuple[list[tuple], int]:
    """Rules for the pieces of one scale, laid out from token position ``at`` on, and the end.

    The piece of rank r, lo <= r < hi, goes to position base + (r - lo) * stride; with
    part >= 0 that is its part of that number, ``shift`` tokens into the piece.
    """
    rules, used = [], dict.fromkeys(histogram, 0)
    box = full * unit
    for combo, repeats in plan(histogram, full):
        offset = 0
        for size in combo:
            lo = used[size]
            rules.append((kind, size, -1, lo, lo + repeats, at + offset * unit, box, 0, size * unit))
            used[size] += repeats
            offset += size
        at += repeats * box
    # the rest, cut into powers of two: large powers first, so none lies across a box's end
    for power in powers(full - 1):
        for size in sorted(histogram):
            rest = histogram[size] - used[size]
            if rest and size & power:
                part = powers(size).index(power)
                shift = (size - size % (2 * power)) * unit
                tokens = power * unit
                rules.append((kind, size, part, used[size], histogram[size], at, tokens, shift, tokens))
                at += rest * tokens
    return rules, at


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A null or empty text is its end id alone; a null key is kept; equal rows are packed one by
    one; other columns are left out.  All sequences are full, except the last of the bodies
    and the last of the tails.  ``tokenizer``: path of a tokenizer file every executor has.
    """
    spark = docs.sparkSession
    cells = cut(pieces(docs, tokenizer, end_id, key, text))
    # `number` runs from 0 within a task, so the largest one gives the count
    per_task = cut(cells.groupBy("kind", "size", "task").agg((F.max("number") + 1).alias("n")))
    before = Window.partitionBy("kind", "size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("kind", "size", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # bounded: at most one row per kind and size, 1 + WINDOW / UNIT + UNIT of them
    totals = {(r["kind"], r["size"]): r["n"] for r in per_task.groupBy("kind", "size").agg(F.sum("n").alias("n")).collect()}

    whole = totals.get((FULL, WINDOW), 0)
    rules = [(FULL, WINDOW, -1, 0, whole, 0, WINDOW, 0, WINDOW)]
    at = whole * WINDOW
    for kind, unit, full in ((BODY, UNIT, WINDOW // UNIT), (TAIL, 1, UNIT)):
        more, at = rules_of(kind, {s: n for (k, s), n in totals.items() if k == kind}, unit, full, at)
        rules += more
        at = -(-at // WINDOW) * WINDOW
    # bounded by the number of combinations, whatever the input: a few thousand rows
    rule = F.broadcast(spark.createDataFrame(rules, RULE))

    ranked = cells.join(firsts, ["kind", "size", "task"]).withColumn("rank", F.col("first") + F.col("number"))
    put = ranked.join(rule, ["kind", "size"]).filter("rank >= lo AND rank < hi")
    position = F.col("base") + (F.col("rank") - F.col("lo")) * F.col("stride")
    return put.select(
        key,
        (F.col("start") + F.col("shift")).alias("start"),
        F.col("tokens").alias("length"),
        F.when(F.col("part") < 0, F.col("crc")).otherwise(F.get("parts", F.col("part"))).alias("ids_crc32"),
        "doc_tokens",
        ((position - position % WINDOW) / WINDOW).cast("bigint").alias("sequence_id"),
        (position % WINDOW).alias("offset"),
    )
