import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from passbook.llm import conversation_trie
from passbook.llm.conversation_trie import DoubleArray, trie_nodes

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, c int"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - int(abs(c) % 5 * (1 if c >= 0 else -1)), [])[:h] + mine[h:]
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(set)
    for k in members:
        if k:
            children[k[:-1]].add(k)

    def under(k):
        leaves, saved = int(not children[k]), (len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0
        for x in children[k]:
            a, b = under(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(children[k]), *under(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(7)
    got = trie_nodes(df)
    assert got.columns == conversation_trie.COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def random_rows(rng, n, longest=7):
    said = ["", "hi", "é", "go on", "stop", None]
    rows = []
    for c in range(n):
        rows += [(c, t, rng.choice(["user", None, "assistant"][: 1 + t % 3]), rng.choice(said[: 2 + t % 5])) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize("limit", [1, 3, 20_000])
def test_against_plain_loop(spark, monkeypatch, limit):
    """Shared prefixes, with upper nodes of every size; equal conversations; null and negative ids."""
    monkeypatch.setattr(conversation_trie, "LIMIT", limit)
    rng = random.Random(limit)
    rows = random_rows(rng, 120)
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1030) for t in range(3)]
    rows += [(-c, t, "user", f"same {t % 2}") for c in range(1, 20) for t in range(2)] + [(None, 0, "user", "x"), (400, None, None, None)]
    check(spark, rows)


def test_long_conversation_and_repeated_turns(spark):
    """One conversation holds most rows, over several tasks; two others share its beginning; rows come twice."""
    rows = [(5, t, "user", f"t{t}") for t in range(900)] + [(c, t, "user", f"t{t}") for c in (10, 15) for t in range(300)]
    rows += [(20, 1, "user", "a"), (20, 1, "user", "a"), (20, 1, "user", "a")]
    check(spark, rows)


def test_empty(spark):
    assert trie_nodes(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(3, 0, None, None)])
    with pytest.raises(TypeError):
        trie_nodes(spark.createDataFrame([], SCHEMA), conv_id="text")


def test_double_array_holds_its_words_and_no_others():
    rng = random.Random(2)
    words = sorted({tuple(rng.choices(range(1, 9), k=rng.randint(1, 6))) for _ in range(400)} | {(x,) for x in range(1, 2000, 7)})
    trie = DoubleArray(words)
    prefixes = {w[:d] for w in words for d in range(1, len(w) + 1)}
    assert sum(c >= 0 for c in trie.check[1:]) == len(prefixes)
    states = {p: list(trie.walk(p))[-1] for p in prefixes}
    assert len(set(states.values())) == len(prefixes)
    for _ in range(500):
        w = tuple(rng.choices(range(1, 12), k=4))
        assert len(list(trie.walk(w))) == max((d for d in range(1, 5) if w[:d] in prefixes), default=0)
