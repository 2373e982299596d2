import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from passbook.llm import importance
from passbook.llm.importance import radix_ranks, resample


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, target, percent, buckets, min_words, most=1):
    def runs(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    held = [[zlib.crc32(x.encode()) % buckets for x in runs(t)] for _, t in rows]
    s, t = Counter(b for h in held for b in h), Counter(zlib.crc32(x.encode()) % buckets for v in target for x in runs(v))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for (k, text), h in zip(rows, held, strict=True):
        weight = sum(map(gain, h))
        noise = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296)))
        out.append((k, len(h), weight, score, len(words(text)) >= min_words))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(order) * percent // 100
    ranks = [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(order)]
    return ranks + [(*r[:4], None) for r in out if not r[4]]


def sort(rows):
    return sorted(map(tuple, rows), key=repr)


def texts(rng, n):
    vocabulary = ["".join(rng.choices("abcé0", k=3)) for _ in range(60)]
    return [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("block", [4, 1 << 16])
def test_against_plain_loop(spark, monkeypatch, block):
    """Null and repeated keys, odd texts, extra columns with clashing names, blocks of any size."""
    monkeypatch.setattr(importance, "BLOCK", block)
    rng = random.Random(3)
    rows = [(rng.choice([i, i - 60, None, 7]), t) for i, t in enumerate(texts(rng, 120))]
    rows += [(1, None), (2, ""), (3, "ÀB àb A\x00B \U0001f600"), (4, "x " * 20000), (7, rows[0][1]), (7, rows[0][1])]
    target = [*texts(rng, 10), None, ""]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, rank int, key string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for most in (1, 2):
        got = resample(docs, aim, 30, buckets=50, min_words=10, most=most)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sort(got.collect()) == sort(brute(rows, target, 30, 50, 10, most))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    aim = spark.createDataFrame([], "text string")
    assert resample(docs, aim).collect() == []
    rows = [(i, f"a b c {i}") for i in range(4)]
    some = spark.createDataFrame(rows, docs.schema)
    assert sort(resample(some, aim, 50, min_words=4).collect()) == sort(brute(rows, [], 50, 10_000, 4))
    with pytest.raises(TypeError):
        resample(some, aim, key="text")


def test_radix_ranks_of_hot_and_extreme_keys(spark, monkeypatch):
    """A third of the rows share all but the last part; keys span all 64 bits."""
    monkeypatch.setattr(importance, "BLOCK", 16)
    rng = random.Random(5)
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1]
    rows = [(5 if i % 3 == 0 else rng.choice(ends + list(range(40))), i, i // 16, i % 16) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k bigint, i bigint, block bigint, place bigint")
    got = radix_ranks(df, {"i": F.col("i"), "k": importance.unsigned(F.col("k"))}).collect()
    assert [(r.k, r.i) for r in sorted(got, key=lambda r: r["rank"])] == sorted((r[0], r[1]) for r in rows)
    assert sorted(r["rank"] for r in got) == list(range(1, 301))
