"""Benchmark passages in documents, also with other numbers, names and units.

Texts become templates: numbers, unit words and capitalised words inside a sentence are
replaced by typed placeholders, other words are lower-cased, punctuation goes.  Windows of
template words are joined by hash.  Windows of one document and item that lie on the same
diagonal are one alignment; it counts if every value of the item's slots meets one value only
in the document, or if the windows with equal values are enough by themselves.  Alignments on
near diagonals add up, as words put in or left out move the diagonal; a word of the item or of
the document counts once.

Templates need words that tell something, so a window mostly of slots is none.  Besides them
windows with names as lower-cased words, and windows of the lower-cased words themselves, are
joined: copies in other case, and copies of items mostly of numbers, names and units, are found.

A Bloom filter of the items' windows, of fixed size, keeps other windows of the documents out
of the shuffle; the join decides.
"""

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passbook.llm.common import row_names, slices

WINDOW = 8
#: Shorter items are one window of their own length, from so many words on.
SHORTEST = 4
#: Share of an item that an alignment must cover, or words.
COVERAGE, RUN = 0.5, 20
#: Diagonals are near up to this share of the item's words, and up to WINDOW.
NEAR = 0.25
BLOOM_BITS = 1 << 23
SLICE_BYTES = 2_000_000
MEMO = 400_000

TOKEN = re.compile(r"[^\W\d_]+|[.!?:\n]|\d+(?:[.,]\d+)*")
UNITS = frozenset(
    "km m cm mm kg g mg t lb lbs oz l ml mile miles yard yards foot feet inch inches hour hours minute minutes second seconds "
    "day days week weeks month months year years dollar dollars euro euros cent cents percent degrees metre metres meter meters "
    "litre litres liter liters gram grams kilogram kilograms kilometre kilometres kilometer kilometers".split()
)
PLAIN, NUMBER, UNIT, CAPITAL, MARK = range(5)
NAMES = {NUMBER: "number", UNIT: "unit", CAPITAL: "name"}
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(WINDOW)], dtype=np.uint64)


class Templates(dict):
    """Template words of texts, as kinds and 64-bit hashes; the dictionary numbers the tokens."""

    def __init__(self):
        super().__init__()
        self.kinds, self.hashes, self.values = np.zeros(1024, np.int8), np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        value = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        if token in ".!?:\n":
            kind = MARK
        elif token[0].isdigit():
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if token[0].isupper() else PLAIN
        at = self[token] = len(self)
        if at == len(self.kinds):
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.kinds[at], self.values[at] = kind, value
        self.hashes[at] = xxhash.xxh3_64_intdigest("\x00" + NAMES[kind]) if kind in (NUMBER, UNIT) else value
        return at

    NAME_HASH = np.uint64(0xA5B3_5705_0F0E_1F2D)

    def of(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, and of the words among them: place, kind, hash, hash with names as words, hash of the word itself."""
        if len(self) > MEMO:
            self.clear()
        tokens = TOKEN.findall(text)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        kinds, hashes = self.kinds[at], self.hashes[at]
        first = np.ones(len(at), dtype=bool)
        first[1:] = kinds[:-1] == MARK
        name = (kinds == CAPITAL) & ~first
        named = np.where(name, self.NAME_HASH, hashes)
        words = np.nonzero(kinds != MARK)[0]
        kinds = np.where((kinds == CAPITAL) & first, PLAIN, kinds)[words]
        return tokens, words, kinds, named[words], hashes[words], self.values[at[words]]


def hashed(hashes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the windows that begin at ``at``, by default of all."""
    n = max(0, len(hashes) - size + 1) if at is None else len(at)
    total = np.full(n, size, dtype=np.uint64)
    for j in range(size if n else 0):
        total += (hashes[j : j + n] if at is None else hashes[at + j]) * MIX[j]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def windows(
    kinds: np.ndarray, named: np.ndarray, hashes: np.ndarray, values: np.ndarray, size: int, exact: bool = True
) -> list[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(kinds of the slots, starts, hashes) of the windows of each form.

    Templates, if at least half their words are no slots; the same with names as words, where
    there are names; with ``exact`` all windows of the words themselves that have a slot in
    the first form.
    """
    n = len(kinds) - size + 1
    if n <= 0:
        return []

    def count(of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of)])
        return total[size:] - total[:-size]

    names, others = count(kinds == CAPITAL), count((kinds == NUMBER) | (kinds == UNIT))
    keep = np.nonzero(2 * (names + others) <= size)[0]
    out = [((NUMBER, UNIT, CAPITAL), keep, hashed(named, size)[keep])]
    at = np.nonzero((names > 0) & (2 * others <= size))[0]
    out.append(((NUMBER, UNIT), at, hashed(hashes, size, at)))
    if exact:
        # without numbers and units the second form is the word's own already
        at = np.nonzero((others > 0) | (names > 0) & (2 * others > size))[0]
        out.append(((), at, hashed(values, size, at)))
    return out


ROW = "pos int, size int, hash bigint, slots array<struct<kind: int, value: string>>, n_words int"


def template_windows(df: DataFrame, key: str, text: str, sizes: list[int] | None, bloom=None) -> DataFrame:
    """(key, pos, size, hash, slots, n_words) of the windows of every text.

    ``sizes`` None: WINDOW, or the whole text where it is shorter.  ``bloom``: a broadcast
    filter; windows it rules out are left out.
    """
    schema = StructType([df.schema[key], *StructType.fromDDL(ROW).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in slices(batches, text, SLICE_BYTES):
            out = []
            for name, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                tokens, words, kinds, *hashes = templates.of(value or "")
                # numbers alone are no passage, so an item of nothing else has no exact windows
                exact = sizes is not None or bool((kinds != NUMBER).any())
                forms = [(size, *w) for size in sizes or [min(WINDOW, max(SHORTEST, len(words)))] for w in windows(kinds, *hashes, size, exact)]
                for size, slotted, at, found in forms:
                    if bloom is not None and len(at):
                        bit = found % np.uint64(BLOOM_BITS)
                        hit = bloom.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)
                        at, found = at[hit == 1], found[hit == 1]
                    for p, h in zip(at.tolist(), found.astype(np.int64).tolist(), strict=True):
                        slots = [
                            {"kind": int(kinds[i]), "value": tokens[words[i]].lower()} for i in range(p, p + size) if kinds[i] in slotted
                        ]
                        out.append((name, p, size, h, slots, len(words)))
            if out:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(key, text).mapInArrow(run, schema)


def bloom_of(hashes: DataFrame):
    """The filter as a broadcast array of BLOOM_BITS bits: bounded, whatever the number of items."""
    blocks = hashes.select(
        F.expr(f"cast((hash & {BLOOM_BITS - 1}) div 64 AS int)").alias("block"),
        F.expr("shiftleft(1L, cast(hash & 63 AS int))").alias("bit"),
    )
    found = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    for r in blocks.groupBy("block").agg(F.bit_or("bit").alias("bits")).collect():
        found[r["block"]] = np.uint64(r["bits"] & 0xFFFF_FFFF_FFFF_FFFF)
    return hashes.sparkSession.sparkContext.broadcast(found)


def union_size(starts: set[int], size: int) -> int:
    """Words in the windows of ``size`` words that begin at ``starts``."""
    total, end = 0, -1
    for at in sorted(starts):
        total += size if at >= end else at + size - end
        end = at + size
    return total


def merged(pairs: set[tuple], values: dict) -> dict | None:
    """``values`` with ``pairs`` put in, or None if an item value meets two values then."""
    out = dict(values)
    return out if all(out.setdefault(a, b) == b for a, b in pairs) else None


def aligned(lines: dict[int, list], size: int, near: int, most: int) -> tuple[int, str, int]:
    """(covered, kind, n_windows) of the best alignment over near diagonals.

    ``lines``: per diagonal the (item place, document place, values are equal, pairs of values).
    """
    known = {}
    for d, hits in lines.items():
        pairs = {p for h in hits for p in h[3]}
        every, equal = {h[0] for h in hits}, {h[0] for h in hits if h[2]}
        use = every if merged(pairs, {}) is not None else equal
        known[d] = union_size(use, size), every, equal, pairs
    order = sorted(known, key=lambda d: (-known[d][0], d))
    best = (0, "", 0)
    for d in order:
        # the largest first: a diagonal joins with all its windows if its values agree, else with the equal ones
        band = [d, *(e for e in order if e != d and abs(e - d) <= near)]
        if min(most, sum(known[e][0] for e in band)) <= best[0]:
            continue
        used, same, values = set(), set(), {}
        for e in band:
            _, every, equal, pairs = known[e]
            agreed = merged(pairs, values)
            values = values if agreed is None else agreed
            used |= {(p, p + e) for p in (equal if agreed is None else every)}
            same |= {(p, p + e) for p in equal}
        covered, alike = (min(union_size({x[i] for x in s}, size) for i in (0, 1)) for s in (used, same))
        best = max(best, (covered, "exact" if alike == covered else "template", len({p for p, _ in used})))
        if best[0] == most:
            break
    return best


BEST = "w struct<covered: int, kind: string, n_windows: int, n_words: int>"


def best_alignments(groups: DataFrame) -> DataFrame:
    """(__key, __item, w) of rows (__key, __item, found, places, size, n_words)."""
    schema = StructType([groups.schema["__key"], groups.schema["__item"], *StructType.fromDDL(BEST).fields])
    arrow = to_arrow_schema(schema)

    def of(row: dict) -> dict:
        size, most = row["size"], row["n_words"]
        near = max(WINDOW, int(NEAR * most))
        places = defaultdict(list)
        for p in row["places"]:
            places[p["hash"]].append((p["pos"], p["values"]))
        blocks = defaultdict(list)
        # a copy is at most so long, so one of two overlapping blocks has it whole
        long = most + near + WINDOW
        for f in row["found"]:
            blocks[f["pos"] // long].append(f)
        best = (0, "", 0)
        for k in {x for b in blocks for x in (b - 1, b)}:
            lines = defaultdict(list)
            for f in (*blocks.get(k, ()), *blocks.get(k + 1, ())):
                for at, values in places[f["hash"]]:
                    lines[f["pos"] - at].append((at, f["pos"], values == f["values"], list(zip(values, f["values"], strict=True))))
            best = max(best, aligned(lines, size, near, most))
            if best[0] == most and best[1] == "exact":
                break
        return {"covered": best[0], "kind": best[1], "n_windows": best[2], "n_words": most}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                found.append(of(batch.slice(i, 1).select(["found", "places", "size", "n_words"]).to_pylist()[0]))
            columns = [batch.column("__key"), batch.column("__item"), pa.array(found, arrow.field("w").type)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return groups.select("__key", "__item", "found", "places", "size", "n_words").mapInArrow(run, schema)


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(__key, __item, w) of every text that has a text of a benchmark item; see ``contaminated``.

    ``__key`` and ``__item`` name a row by its key and text.
    """
    own = items.select(F.struct(*row_names(item, item_text)).alias("__item"), F.col(item_text).alias("__text"))
    b = template_windows(own, "__item", "__text", None)
    place = F.struct("pos", "hash", F.col("slots.value").alias("values"))
    # all places of an item's windows; a text has windows of one size
    wholes = b.groupBy("__item").agg(F.first("size").alias("size"), F.first("n_words").alias("n_words"), F.collect_list(place).alias("places"))
    b = b.select("__item", "hash", "size", "n_words").distinct()
    sizes = sorted(r["size"] for r in b.select("size").distinct().collect()) or [WINDOW]  # at most WINDOW of them
    own = docs.select(F.struct(*row_names(key, text)).alias("__key"), F.col(text).alias("__text"))
    d = template_windows(own, "__key", "__text", sizes, bloom_of(b)).drop("n_words")
    hits = d.join(b, ["hash", "size"]).select("__key", "__item", "size", "n_words", place.alias("found"))
    # equal rows have equal windows, and a text has at most three at a place
    groups = hits.groupBy("__key", "__item").agg(F.max("size").alias("size"), F.max("n_words").alias("n_words"), F.collect_set("found").alias("found"))
    groups = groups.withColumn("at", F.array_distinct(F.sort_array(F.col("found.pos"))))
    # no alignment covers more words than the windows have in the whole document
    most = F.expr("aggregate(transform(at, (p, i) -> least(size, coalesce(get(at, i + 1), p + size) - p)), 0, (a, x) -> a + x)")
    groups = groups.filter((most >= COVERAGE * F.col("n_words")) | (most >= RUN)).select("__key", F.col("__item").alias("__whole"), "found")
    groups = groups.join(wholes, F.col("__whole") == F.col("__item"))
    best = best_alignments(groups)
    enough = (F.col("w.covered") >= COVERAGE * F.col("w.n_words")) | (F.col("w.covered") >= RUN)
    return best.filter(enough)


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(key, item, kind, n_windows, covered, n_words) of documents that have a benchmark item.

    ``kind``: exact if all slots are equal, else template; ``covered`` of the item's
    ``n_words`` words lie in matching windows of its best alignment.  Items shorter than
    SHORTEST words, and null or empty texts, match nothing.  Rows that share a key are one
    document with several texts, each aligned by itself; a null key is a key.
    """
    found = matches(docs, items, key, text, item, item_text)
    best = found.groupBy(F.col("__key.key").alias("__key"), F.col("__item.key").alias("__item")).agg(F.max("w").alias("w"))
    return best.select(F.col("__key").alias(key), F.col("__item").alias(item), "w.kind", "w.n_windows", "w.covered", "w.n_words")


def drop_contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` without the rows whose text has a benchmark item, whatever key they share."""
    bad = matches(docs, items, key, text, item, item_text).select(F.col("__key").alias("__bad")).distinct()
    name, h1, h2 = row_names(key, text)
    same = name.eqNullSafe(F.col("__bad.key")) & (h1 == F.col("__bad.h1")) & (h2 == F.col("__bad.h2"))
    return docs.join(bad, same, "left_anti")
