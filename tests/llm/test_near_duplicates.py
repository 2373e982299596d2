import random
import re
from collections import defaultdict

import pytest

from passbook.llm import graph
from passbook.llm import near_duplicates as nd
from passbook.llm.common import table
from passbook.llm.graph import components


def shingle_set(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """key -> component, over all pairs that share a shingle."""
    sets = [(k, shingle_set(t)) for k, t in rows]
    up = {k: k for k, _ in rows}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    having = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            having[x].append(i)
    for i, (k, s) in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in having[x]:
                if j < i:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j][1]) - n):
                a, b = root(k), root(sets[j][0])
                up[max(a, b)] = min(a, b)
    return {k: root(k) for k, _ in rows}


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = "".join(rng.choices("abcdefgh", k=7))
    return " ".join(words)


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, n string")
    want = brute([r for r in rows if r[0] is not None])
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted((k or -1, len(shingle_set(t))) for k, t in rows)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    left = nd.keep_first(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == sorted(k or -1 for k, _ in rows if k is None or want[k] == k)


def test_groups(spark):
    """A star whose copies differ among themselves, chains, exact copies, short and odd texts."""
    rng = random.Random(7)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    star, chain = prose(200), [prose(150)]
    texts = [star] + [edited(rng, star, 5) for _ in range(60)]
    for _ in range(10):
        chain.append(edited(rng, chain[-1], 3))
    texts += chain + [prose(80)] * 30 + [prose(rng.randint(5, 60)) for _ in range(50)]
    texts += [None, "", " \n", "One two", "one\tTWO", "É b c", "é b c", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    check(spark, [(10 + i, t) for i, t in enumerate(texts)])


def test_repeated_keys_and_empty(spark):
    rng = random.Random(9)
    a, b = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50)) for _ in range(2))
    check(spark, [(3, a), (5, a), (5, b), (5, b), (9, b), (None, a), (None, None), (7, edited(rng, b, 1))])
    check(spark, [(1, None)])
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_tables(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    check(spark, rows)


@pytest.mark.parametrize("at_once", [0, 60, 500_000])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "AT_ONCE", at_once)
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(80)]
    rng.shuffle(edges)
    up = {x: x for e in edges for x in e}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: root(k) for k in up if root(k) != k}


def test_pairs_in_a_family_of_one_template(spark):
    """Documents of one template, similarity 0.70 to each other, and pairs among them of 0.76."""
    rng = random.Random(11)
    prose = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    template, rows, want = prose(150), [], {}
    for i in range(0, 1600, 2):
        tail, other = prose(31), prose(24)
        rows += [(i, " ".join(template + tail)), (i + 1, " ".join(template + (tail[:7] + other if i % 10 == 0 else prose(31))))]
        want |= {i: i, i + 1: i if i % 10 == 0 else i + 1}
    sets = [shingle_set(t) for _, t in rows[:4]]
    assert 0.76 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.77
    assert len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.71
    rng.shuffle(rows)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_equal_rows_under_one_key_stay_once(spark):
    rng = random.Random(12)
    a, b = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50)) for _ in range(2))
    rows = [(3, a), (3, a), (3, b), (5, a), (6, "")]
    left = nd.keep_first(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, __n string"))
    assert left.columns == ["doc_id", "text", "__n"]
    assert sorted(tuple(r)[:2] for r in left.collect()) == sorted([(3, a), (3, b), (6, "")])
