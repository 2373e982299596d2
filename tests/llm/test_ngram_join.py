import random
import re
from itertools import combinations

import pytest

from passbook.llm import ngram_join
from passbook.llm.ngram_join import missing, similar_documents


def shingle_set(text, size):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    sets = [(k, shingle_set(t, size)) for k, t in rows if k is not None]
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {k: root(k) for k in up}


def prose(rng, n):
    return ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]


def check(spark, rows, size=3, percent=90):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, n int, node string").repartition(3)
    want = brute(rows, size, percent)
    got = similar_documents(docs, size=size, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    expected = [(k, len(shingle_set(t, size)), None if k is None else want[k]) for k, t in rows]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def family(rng, n, length, edits):
    """Texts that differ from one of them by up to ``edits`` words, and so less or more from one another."""
    base = prose(rng, length)
    out = [" ".join(base)]
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = prose(rng, 1)[0]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 75)])
def test_families_at_the_border(spark, size, percent):
    rng = random.Random(size)
    texts = family(rng, 40, 200, 9) + family(rng, 30, 25, 2) + family(rng, 20, 9, 1)
    shared = prose(rng, 40)  # a passage that many other texts have
    texts += [" ".join(prose(rng, 30) + shared) for _ in range(15)] + [" ".join(prose(rng, rng.randint(1, 30))) for _ in range(20)]
    texts += [None, "", " \n", "One two", "one\tTWO", "É b c", "é b c", "a b c", "a b c d", texts[0], texts[0]]
    rng.shuffle(texts)
    rows = [(i - 5, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, None), (3, texts[1]), (3, texts[1]), (4, "w x y z")]
    check(spark, rows, size, percent)


def test_long_lists_in_small_chunks(spark, monkeypatch):
    """Posting lists of many chunks, groups that run over batches, several rounds of offers."""
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    monkeypatch.setattr(ngram_join, "HELD", 10)
    monkeypatch.setattr(ngram_join, "GROWTH", 2)
    rng = random.Random(8)
    texts = family(rng, 90, 120, 12)
    check(spark, list(enumerate(texts)))


def test_a_pair_is_offered_once(spark, monkeypatch):
    """Texts that meet in many lists, of the same texts: one offer of a pair in a round, and none in lists that are done."""
    made, offers = [], ngram_join.offers

    def counted(*args):
        out = ngram_join.cut(offers(*args))
        made.append(out.filter("b IS NOT NULL").count())
        return out

    monkeypatch.setattr(ngram_join, "offers", counted)
    monkeypatch.setattr(ngram_join, "HELD", 10)
    rng = random.Random(5)
    rows = []
    for _ in range(20):
        base = prose(rng, 400)
        rows += [" ".join(base), " ".join([*base, *prose(rng, 2)])]  # similar
    # two of the lists have more to offer: all but a few words are shared, too few are
    base = prose(rng, 100)
    rows += [" ".join(w if rng.random() > 0.03 else "z" + w for w in base) for _ in range(12)]
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, 10)  # a pair is told apart from others of its task only
    try:
        check(spark, list(enumerate(rows)))
    finally:
        spark.conf.set(batch, before)
    assert 20 <= made[0] <= 150
    assert sum(made[1:]) <= 12 * 11 * len(made)


def test_empty(spark):
    check(spark, [(1, None)])
    assert similar_documents(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_missing_is_the_most_a_similar_set_lacks():
    for percent in (75, 90):
        for n in range(1, 300):
            e = missing(n, percent)
            assert 100 * (n - e) >= percent * n and 100 * (n - e - 1) < percent * n
