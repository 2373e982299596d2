"""Personal data in text: fixed shapes, and segments found by a semi-Markov random field.

The field labels stretches of text around digits and @ signs.  It scores whole spans by
features of the span (how many digits, which separators, the shape of its groups, checksums,
what stands beside it) and chooses boundaries and types together, by dynamic programming over
spans of bounded length.  It is trained on a bounded sample of stretches, with the spans of
the fixed shapes as truth, by stochastic gradients of the conditional likelihood.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passbook.llm.common import slices

KINDS = ["email", "ip", "card", "phone"]
#: Stretches trained on: those of the smallest hash, from so many texts at most in all.
MAX_STRETCHES = 400
ROUNDS, RATE = 6, 0.4
#: A span has at most so many tokens; to train on, a longer stretch is cut in pieces of so many.
MAX_SPAN, MAX_STRETCH = 14, 60
FEATURES = 512
#: A further span must beat leaving its tokens unlabelled by this log-odds.
MARGIN = 1.0
SLICE_BYTES = 2_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, from each @ outwards: linear however long a run of letters is."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        at = done = match.end() if match else at + 1
        if match:
            yield start, match.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed shapes, by start and then kind."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


MARKED = re.compile(r"[^\s]*[0-9@][^\s]*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")


def stretches(text: str, most: int | None = None) -> Iterator[list[tuple[int, int]]]:
    """Tokens (start, end) of the text's stretches: words with digits or @, close ones together.

    ``most``: longer stretches are cut in pieces of so many tokens.
    """
    begin = end = None
    for m in MARKED.finditer(text):
        if end is not None and m.start() - end <= 3:
            end = m.end()
            continue
        if end is not None:
            yield from _tokens(text, begin, end, most)
        begin, end = m.span()
    if end is not None:
        yield from _tokens(text, begin, end, most)


def _tokens(text: str, begin: int, end: int, most: int | None) -> Iterator[list[tuple[int, int]]]:
    # an opening bracket or plus before the first word belongs to it; \S+ has them already
    part = []
    for m in TOKEN.finditer(text, begin, end):
        part.append(m.span())
        if len(part) == most:
            yield part
            part = []
    if part:
        yield part


_SHAPE = str.maketrans("0123456789", "d" * 10)


def span_features(text: str, start: int, end: int, n_tokens: int) -> list[int]:
    """Slots of the features a span has."""
    s = text[start:end]
    digits = re.sub(r"[^0-9]", "", s)
    n = len(digits)
    groups = re.findall(r"[0-9]+", s)
    shape = re.sub(r"[^\W\d_]+", "a", s.translate(_SHAPE))
    shape = re.sub(r"d+", lambda m: str(min(len(m[0]), 9)), shape) if len(shape) < 40 else "long"
    separators = "".join(sorted(set(re.sub(r"\w", "", s))))
    before, after = text[start - 1 : start], text[end : end + 1]
    named = [
        f"digits {n if n < 20 else 20}",
        f"groups {min(len(groups), 6)}",
        f"tokens {min(n_tokens, 8)}",
        f"separators {separators[:8]}",
        f"shape {shape}",
        f"kinds {'@' in s}{bool(re.search(r'[^\W\d_]', s))}{n > 0}",
        f"edges {s[0].isalnum()}{s[0] == '+'}{s[-1].isalnum()}",
        f"cut {before.isalnum() or before in '.@-+_'}{after.isalnum() or after in '@-_'}" if before or after else "free",
        f"luhn {14 <= n <= 19 and luhn(digits)}",
        f"bytes {len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and separators == '.'}",
        f"length {min(n, 16)} {separators[:4]}",
        f"address {s.count('@')}{min(s[s.find('@') :].count('.'), 2) if '@' in s else ''}",
    ]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % FEATURES for f in named]


class Field:
    """Span weights by feature and kind; a token outside any span scores 0."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS))) if weights is None else weights
        self.known: dict[tuple, tuple[float, int]] = {}

    def spans(self, text: str, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(first, end) token numbers of all spans, and their feature counts."""
        n = len(tokens)
        at = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - MAX_SPAN), j)]
        counts = np.zeros((len(at), FEATURES), dtype=np.float32)
        for row, (i, j) in enumerate(at):
            np.add.at(counts[row], span_features(text, tokens[i][0], tokens[j - 1][1], j - i), 1)
        return at, counts

    def train(self, stretch: tuple[str, list[tuple[int, int]], dict[tuple[int, int], int]], rate: float) -> None:
        """One gradient step towards the gold spans of a stretch."""
        text, tokens, gold = stretch
        at, counts = self.spans(text, tokens)
        scores = counts @ self.weights
        n = len(tokens)
        by_end, by_start = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for row, (i, j) in enumerate(at):
            by_end[j].append((i, row))
            by_start[i].append((j, row))
        total = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + total[r] for i, r in by_end[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + total[r] for j, r in by_start[i])])
        ends = np.array(at)
        expected = np.exp(scores + (forward[ends[:, 0]] + backward[ends[:, 1]] - forward[n])[:, None])
        for row, span in enumerate(at):
            if span in gold:
                expected[row, gold[span]] -= 1
        self.weights -= rate * (counts.T @ expected + 1e-4 * self.weights)

    def best_kind(self, text: str, start: int, end: int, n_tokens: int) -> tuple[float, int]:
        """Score and kind of a span, remembered by what its features look at."""
        seen = text[start:end], text[start - 1 : start], text[end : end + 1], n_tokens
        found = self.known.get(seen)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            scores = self.weights[span_features(text, start, end, n_tokens)].sum(axis=0)
            kind = int(scores.argmax())
            found = self.known[seen] = (float(scores[kind]), kind)
        return found

    def label(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
        """The best spans (start, end, kind) of a stretch."""
        n = len(tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for i in range(max(0, j - MAX_SPAN), j):
                score, kind = self.best_kind(text, tokens[i][0], tokens[j - 1][1], j - i)
                if best[i] + score - MARGIN > best[j]:
                    best[j], back[j] = best[i] + score - MARGIN, (i, kind)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
                continue
            i, kind = back[j]
            out.append((tokens[i][0], tokens[j - 1][1], KINDS[kind]))
            j = i
        return out[::-1]


def gold_of(text: str, tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> dict[tuple[int, int], int]:
    """Base spans that begin and end with tokens of the stretch, the longer where two overlap."""
    starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    gold, taken = {}, set()
    for a, b, kind in sorted(spans, key=lambda s: s[0] - s[1]):
        if a in starts and b in ends:
            i, j = starts[a], ends[b]
            if j - i <= MAX_SPAN and not taken & set(range(i, j)):
                gold[i, j] = KINDS.index(kind)
                taken |= set(range(i, j))
    return gold


def training_stretches(docs: DataFrame, text: str, most: int) -> list[str]:
    """At most ``most`` distinct stretches with some text around, by hash: a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(text).to_pylist():
                for tokens in stretches(value, MAX_STRETCH) if value else ():
                    a, b = tokens[0][0], tokens[-1][1]
                    if b - a <= 200:
                        out.append(value[max(0, a - 8) : b + 8])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["stretch"])

    found = docs.select(text).mapInArrow(run, "stretch string").withColumn("h", F.xxhash64("stretch"))
    rows = found.groupBy("h").agg(F.min("stretch").alias("stretch")).orderBy("h").limit(most).collect()
    return [r["stretch"] for r in rows]


def fit(samples: list[str]) -> Field:
    field = Field()
    data = []
    for text in samples:
        spans = base_spans(text)
        data += [(text, tokens, gold_of(text, tokens, spans)) for tokens in stretches(text, MAX_STRETCH)]
    for i in range(ROUNDS):
        for stretch in data:
            field.train(stretch, RATE / (1 + i))
    return field


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, base and further spans); further ones touch no base span."""
    base = base_spans(text)
    if not ("@" in text or DIGIT.search(text)):
        return base, base
    more, next_base = [], 0
    for tokens in stretches(text):
        for a, b, kind in field.label(text, tokens):
            while next_base < len(base) and base[next_base][1] <= a:
                next_base += 1
            # spans go by start, so one of the next few would overlap if any does
            if not any(s < b and a < e for s, e, _ in base[max(0, next_base - 4) : next_base + 8]):
                more.append((a, b, kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SCHEMA = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Counts are of the base spans; offsets count code points.  A null text is empty: no spans.
    Null keys and equal rows are kept; other columns are left out.  ``field``: a trained field;
    by default one is trained on a sample of these texts.
    """
    field = field or fit(training_stretches(docs, text, MAX_STRETCHES))
    schema = StructType([docs.schema[key], *StructType.fromDDL(SCHEMA).fields])
    arrow = to_arrow_schema(schema)
    weights = field.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(weights)
        for batch in slices(batches, text, SLICE_BYTES):
            rows = []
            for value in batch.column(text).to_pylist():
                base, spans = all_spans(value or "", own)
                counts = [sum(s[2] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], schema=arrow)

    return docs.select(key, text).mapInArrow(run, schema)
