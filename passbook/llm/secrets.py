"""Secrets in text: fixed shapes, and strings that pass a battery of randomness tests.

Candidates are long runs of key characters.  Each is read in the smallest encoding that holds
it and tested for being uniform random in that alphabet: chi-squared over symbols and over
kinds of symbols, the number of runs above and below the alphabet's middle, and the serial
correlation of neighbours.  The least p-value, corrected for four tests, says how well "random"
fits.  Random strings have uniform p-values; other ones seldom reach MIN_P, and those that do are
taken as log-uniform.  How many do is guessed from the bits of the string, fewer for longer ones,
and corrected by what the table shows: over all strings, then per encoding, then per encoding and
length, each step shrunk towards the one before.  A stratum's threshold is the least p-value from
which on the expected share of strings that are not random is below a rate, so one long random
string in a small table is found as well.

A run of key characters that fits no encoding is cut at ``+ / - _`` and its parts are tested.

Everything is DataFrame functions on one row; only counts by stratum are shuffled.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.compute import settled
from passbook.llm.common import LOWER, UPPER, hidden, shown, two_sided
from passbook.storage import cut

#: Kind: pattern, group whose length counts, characters it needs at least; in the order of spans.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # the same as whole runs of 32 and more
}
RANDOM, PART = (r"[A-Za-z0-9+/_-]{20,}", 0, 20), (r"[A-Za-z0-9]{20,}", 0, 20)
#: A text without this has no match of the kind.
NEEDS = {"assign": r"[:=]", "access": "AKIA", "hex": r"[0-9a-f]{32}", "random": r"[A-Za-z0-9+/_-]{20}", "part": r"[A-Za-z0-9]{20}"}
DIGITS = "0123456789"
#: Encoding: alphabet, sizes of its kinds of symbols in alphabet order; small alphabets first.
ENCODINGS = {
    "decimal": (DIGITS, [10]),
    "hex": (DIGITS + "abcdef", [10, 6]),
    "HEX": (DIGITS + "ABCDEF", [10, 6]),
    "base32": (UPPER + "234567", [26, 6]),
    "base36": (DIGITS + LOWER, [10, 26]),
    "BASE36": (DIGITS + UPPER, [10, 26]),
    "base62": (DIGITS + UPPER + LOWER, [10, 26, 26]),
    "base64": (DIGITS + UPPER + LOWER + "+/", [10, 26, 26, 2]),
    "base64url": (DIGITS + UPPER + LOWER + "-_", [10, 26, 26, 2]),
}
MIN_BITS = 80
MIN_P, BINS, RATE = 0.001, 1000, 0.05
#: Strings that are not random and reach MIN_P, per random one of a bit; what the guess counts for, in such strings.
LEAK, GUESS = 16.0, 2.0
CHUNK = 256


def match_spans(df: DataFrame, text: str, kinds: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``df`` with a column per kind: its matches as array of (start, end, value, n).

    Leftmost, non-overlapping; offsets in code points, end exclusive; ``n`` is the length of
    the counted group.  Splitting at the pattern gives the gaps between matches, and the sums
    of gaps and matches before a match give its start.  Sums go by chunks, so a text with very
    many matches costs little more than its length.
    """
    columns = {}
    for kind, (pattern, group, _) in kinds.items():
        there = F.col(text).rlike(NEEDS[kind])
        columns[f"__m_{kind}"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        columns[f"__g_{kind}"] = F.when(there, F.split(text, pattern, -1))
        if group:
            columns[f"__v_{kind}"] = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    df = settled(df, **columns)
    # steps from one match's start to the next: match and gap behind it
    step = "transform(__m_{k}, (m, i) -> length(m) + length(__g_{k}[i + 1]))"
    df = settled(df, **{f"__d_{k}": F.expr(step.format(k=k)) for k in kinds})
    chunks = "transform(sequence(0, size(__d_{k}) div {c}), j -> aggregate(slice(__d_{k}, j * {c} + 1, {c}), 0, (a, x) -> a + x))"
    df = settled(df, **{f"__c_{k}": F.expr(chunks.format(k=k, c=CHUNK)) for k in kinds})
    first = "aggregate(__c_{k}, array(length(__g_{k}[0])), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    df = settled(df, **{f"__f_{k}": F.expr(first.format(k=k)) for k in kinds})
    starts = (
        "flatten(transform(__c_{k}, (x, j) -> "
        "aggregate(slice(__d_{k}, j * {c} + 1, {c}), array(__f_{k}[j]), (a, y) -> concat(a, array(element_at(a, -1) + y)),"
        " a -> slice(a, 1, size(a) - 1))))"
    )
    df = settled(df, **{f"__s_{k}": F.expr(starts.format(k=k, c=CHUNK)) for k in kinds})
    spans = "transform(__m_{k}, (m, i) -> named_struct('start', __s_{k}[i], 'end', __s_{k}[i] + length(m), 'value', m, 'n', length({v})))"
    kind_type = "array<struct<start: int, end: int, value: string, n: int>>"
    df = settled(
        df,
        **{
            k: F.coalesce(F.expr(spans.format(k=k, v=f"__v_{k}[i]" if kinds[k][1] else "m")), F.array().cast(kind_type))
            for k in kinds
        },
    )
    return df.drop(*[c for c in df.columns if c.startswith(("__m_", "__g_", "__v_", "__d_", "__c_", "__f_", "__s_"))])


def _upper_tail(x: Column, freedom: Column) -> Column:
    """P(chi-squared > x), by Wilson's and Hilferty's cube root."""
    v = 2 / (9 * freedom)
    z = (F.pow(x / freedom, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)
    return F.when(z > 0, two_sided(z) / 2).otherwise(1 - two_sided(z) / 2)


def fit(value: Column) -> Column:
    """(encoding, bits, p) of a string: how well it fits a random string of its encoding.

    Null where no encoding holds it.
    """
    result = F.lit(None).cast("struct<encoding: string, bits: double, p: double>")
    for name, (alphabet, sizes) in reversed(ENCODINGS.items()):
        k = len(alphabet)
        n = F.length(value)
        letters = F.array(*[F.lit(c) for c in alphabet])
        counts = F.transform(letters, lambda c: (n - F.length(F.replace(value, c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        tests = [_upper_tail(squares * k / n - n, F.lit(k - 1.0))]
        if len(sizes) > 1:
            at, kinds = 0, F.lit(0.0)
            for size in sizes:
                own = n - F.length(F.translate(value, alphabet[at : at + size], ""))
                kinds = kinds + own * own * k / (n * size)
                at += size
            tests.append(_upper_tail(kinds - n, F.lit(len(sizes) - 1.0)))
        halves = F.translate(value, alphabet, "0" * (k // 2) + "1" * (k - k // 2))
        turns = sum((n - F.length(F.replace(halves, F.lit(two), F.lit("")))) / 2 for two in ("01", "10"))
        tests.append(two_sided((turns - (n - 1) / 2) / F.sqrt((n - 1) / 4)))
        place = F.transform(F.split(value, ""), lambda c: (F.instr(F.lit(alphabet), c) - 1 - (k - 1) / 2).cast("double"))
        shifted = F.zip_with(F.slice(place, 1, n - 1), F.slice(place, 2, n - 1), lambda a, b: a * b)
        spread = (k * k - 1) / 12
        tests.append(two_sided(F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x) / (spread * F.sqrt(n - 1))))
        least = reduce(F.least, tests)
        p = 1 - F.pow(1 - least, F.lit(len(tests)))
        inside = F.length(F.translate(value, alphabet, "")) == 0
        result = F.when(
            inside, F.struct(F.lit(name).alias("encoding"), (n * math.log2(k)).alias("bits"), p.alias("p"))
        ).otherwise(result)
    return result


KINDS = [*BASE, "random"]
SPAN = "array<struct<start: int, place: int, end: int, kind: string>>"


def placed(spans: Column, kind: str) -> Column:
    """Spans as they are sorted and written."""
    place = F.lit(KINDS.index(kind)).alias("place")
    return F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), place, x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def found(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with base (spans of the fixed shapes) and candidates (further strings, tested)."""
    df = match_spans(settled(docs, __text=F.coalesce(F.col(text), F.lit(""))), "__text", {**BASE, "random": RANDOM, "part": PART})
    spans = [placed(F.expr(f"filter({kind}, x -> x.n >= {least})"), kind) for kind, (_, _, least) in BASE.items()]
    df = settled(df, base=F.sort_array(F.concat(*spans)).cast(SPAN)).drop("__text")
    # runs that no encoding holds, and the parts inside them
    mixed = F.filter("random", lambda x: x["value"].rlike("[+/]") & x["value"].rlike("[_-]"))
    df = settled(df, mixed=mixed)
    parts = F.filter("part", lambda x: F.exists("mixed", lambda m: (m["start"] <= x["start"]) & (x["end"] <= m["end"])))
    parts = F.when(F.size("mixed") > 0, F.concat(F.array_except("random", "mixed"), parts)).otherwise(F.col("random"))
    df = settled(df, whole=parts)
    free = F.filter(
        "whole", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    )
    df = settled(df, candidates=free).drop(*KINDS, "part", "mixed", "whole")
    tested = F.transform(
        "candidates", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), fit(x["value"]).alias("fit"))
    )
    df = settled(df, candidates=tested)
    stratum = lambda x: F.concat_ws(":", x["fit"]["encoding"], F.floor(F.log2(x["end"] - x["start"])).cast("string"))
    return settled(
        df,
        candidates=F.transform(
            F.filter("candidates", lambda x: x["fit"]["bits"] >= MIN_BITS),
            lambda x: F.struct(
                x["start"].alias("start"), x["end"].alias("end"), stratum(x).alias("stratum"), x["fit"]["p"].alias("p")
            ),
        ),
    )


def least_bits(stratum: str) -> float:
    """Bits of the shortest string of a stratum."""
    encoding, doublings = stratum.split(":")
    return max(MIN_BITS, 2 ** int(doublings) * math.log2(len(ENCODINGS[encoding][0])))


def leaks(counts: dict[str, dict[int, int]], guess: float, rounds: int = 100) -> float:
    """How many times the guessed number of strings that are not random reach MIN_P in ``counts`` (stratum: bin: n).

    Expectation maximisation of a mixture of uniform and log-uniform p-values, shrunk towards ``guess``.
    """
    theta = guess
    for _ in range(rounds):
        other = expected = 0.0
        for stratum, bins in counts.items():
            odds = LEAK / least_bits(stratum)
            for b, n in bins.items():
                density = theta * odds / ((b + 0.5) / BINS * -math.log(MIN_P))
                other += n * density / (1 + density)
                expected += n / (1 + density) * odds
        before, theta = theta, (other + GUESS) / (expected + GUESS / guess)
        if abs(theta - before) < 1e-6 * theta:
            break
    return theta


def thresholds(df: DataFrame, rate: float = RATE) -> dict[str, float]:
    """Stratum: least p-value that is accepted; a stratum may have none.

    Counts go by stratum (encodings times doublings of length) and bin of p from MIN_P on: a table
    of bounded size, which reaches the driver.
    """
    one = df.select(F.explode("candidates").alias("c")).select(
        "c.stratum", F.least(F.lit(BINS - 1), F.floor(F.col("c.p") * BINS)).cast("int").alias("bin")
    )
    counts: dict[str, dict[int, int]] = {}
    for r in one.filter(F.col("bin") >= MIN_P * BINS).groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    overall, limits = leaks(counts, 1.0), {}
    for encoding in sorted({s.split(":")[0] for s in counts}):
        own = {s: bins for s, bins in counts.items() if s.split(":")[0] == encoding}
        theta = leaks(own, overall)
        for stratum, bins in own.items():
            odds = leaks({stratum: bins}, theta) * LEAK / least_bits(stratum)
            for b in range(round(MIN_P * BINS), BINS):
                t = b / BINS
                other = odds * math.log(t) / math.log(MIN_P)
                if other <= rate * (other + 1 - t):
                    limits[stratum] = t
                    break
    return limits


def accepted(limits: dict[str, float]) -> Column:
    """All spans of a row, by start and then kind."""
    passes = lambda x: reduce(
        lambda a, kv: a | ((x["stratum"] == kv[0]) & (x["p"] >= kv[1])), limits.items(), F.lit(False)
    )
    return F.sort_array(F.concat("base", placed(F.filter("candidates", passes), "random").cast(SPAN)))


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row.

    A null text is empty: no spans.  Offsets count code points.  Strings inside or across a
    base span add none.  Null keys and equal rows are kept; other columns are left out.
    """
    df = cut(found(docs.select(F.col(key).alias("__key"), F.col(text).alias("__in")), "__in").drop("__in"))
    df = settled(df, spans=accepted(thresholds(df)))
    counts = [F.expr(f"size(filter(spans, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return df.select(
        F.col("__key").alias(key), *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every accepted span of ``text`` replaced by ``mark``; overlapping spans by one.

    Texts without spans, null ones among them, stay as they are.  Candidates are found and
    tested once and written together with the rows; no text is shuffled.
    """
    text_column = F.col(f"__{docs.columns.index(text)}")
    df = cut(found(hidden(docs, text), "__in").drop("__in")).withColumn("__in", text_column)
    df = settled(df, spans=accepted(thresholds(df)))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a, x):
        """Text up to the span and the mark, unless the span begins inside the one before."""
        more = F.concat(a["out"], F.substring("__in", a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        out = F.when(x["start"] < a["at"], a["out"]).otherwise(more)
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring("__in", a["at"] + 1, F.length("__in"))))
    df = settled(df, __in=F.when(F.size("spans") > 0, clean).otherwise(F.col("__in")))
    return shown(df, docs.columns, **{text: F.col("__in")})
