import random

import public_tokenizers
from pyspark.sql import Row

from passbook.llm import token_counts as tc

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


def best(pieces, byte_score, word):
    """The same dynamic programme over one word, without sharing."""
    s = "▁" + word
    score, length = [0.0], [0]
    for end in range(1, len(s) + 1):
        size = len(s[end - 1].encode())
        top, n = score[end - 1] + size * byte_score, length[end - 1] + size
        for start in range(end):
            p = pieces.get(s[start:end])
            if p is not None and score[start] + p > top:
                top, n = score[start] + p, length[start] + 1
        score.append(top)
        length.append(n)
    return length[-1]


def test_trie_equals_single_words(monkeypatch):
    monkeypatch.setattr(tc, "MAX_COUNTS", 200)  # the counts are dropped several times
    rng = random.Random(3)
    pieces = {"".join(rng.choices("ab▁c", k=rng.randint(1, 4))): -rng.uniform(1, 9) for _ in range(60)}
    trie = tc.PieceTrie(pieces)
    for _ in range(40):
        words = {"".join(rng.choices("abcdé", k=rng.randint(1, 12))) for _ in range(50)}
        trie.add(words)
        assert all(trie.counts[w] == best(pieces, trie.byte_score, w) for w in words)


def test_odd_rows(spark):
    long = "wort " * 300_000
    rows = [
        Row(doc_id=1, text=None, n_tokens="clash"),
        Row(doc_id=None, text="", n_tokens=None),
        Row(doc_id=2, text=" \n\t ", n_tokens="x"),
        Row(doc_id=3, text="the the 漢字", n_tokens="x"),
        Row(doc_id=3, text="the the 漢字", n_tokens="x"),
        Row(doc_id=4, text=long, n_tokens="x"),
    ]
    got = tc.token_counts(spark.createDataFrame(rows), PATH)
    pieces = tc.load_pieces(PATH)
    trie = tc.PieceTrie(pieces)
    want = sorted(
        (r.doc_id or 0, len((r.text or "").split()), sum(best(pieces, trie.byte_score, w) for w in (r.text or "").split()[:9]))
        for r in rows if r.text != long
    )
    found = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in got.collect())
    assert found[:-1] == want
    assert found[-1] == (4, 300_000, 300_000 * best(pieces, trie.byte_score, "wort"))
    assert tc.token_counts(spark.createDataFrame(rows).limit(0), PATH).count() == 0
