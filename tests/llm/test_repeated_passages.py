import hashlib
import random
from collections import Counter

import pytest

from passbook.llm import repeated_passages as rp
from passbook.llm.common import table


def brute(texts):
    """(bytes, removed, spans, hash) of every text, from all strings of LENGTH bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter()
    for d in data:
        for i in range(len(d) - rp.LENGTH + 1):
            seen[hashlib.blake2b(d[i : i + rp.LENGTH], digest_size=12).digest()] += 1
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - rp.LENGTH + 1):
            if seen[hashlib.blake2b(d[i : i + rp.LENGTH], digest_size=12).digest()] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + rp.LENGTH
                else:
                    spans.append([i, i + rp.LENGTH])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        kept += d[at:]
        out.append((len(d), len(d) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id bigint, text string, t1 string")
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rp.repeated_passages(docs).collect())
    want = sorted((k or -1, *b) for (k, _), b in zip(rows, brute([t for _, t in rows]), strict=True))
    assert got == want


def prose(rng, n):
    out = ""
    while len(out.encode()) < n:
        out += rng.choice("abcdefé ñ\n")
    return out


@pytest.mark.parametrize("block", [rp.BLOCK, 1000])
def test_planted(spark, monkeypatch, block):
    """Passages just long enough or not, overlapping, at borders, in one text, in copies, periodic."""
    monkeypatch.setattr(rp, "BLOCK", block)
    rng = random.Random(11)
    a, b, c = prose(rng, 900), prose(rng, 400), prose(rng, 399)
    ascii_ = "".join(rng.choices("abcdefgh", k=1200))
    texts = [a, "x" + a[:500], a[200:] + "y", prose(rng, 300) + b, b + prose(rng, 300), c + prose(rng, 90), prose(rng, 10) + c]
    texts += [prose(rng, 700) + b + prose(rng, 50) + b, ascii_, "0" + ascii_[1:400], "0" + ascii_[1:401], ascii_[:700] + "#" + ascii_[701:]]
    texts += [ascii_[300:701], ascii_[300:699] + "!", "z" * 1500, "ab" * 400, "ab" * 300 + "c", prose(rng, 399), "", None, None]
    texts += [prose(rng, 5000)] * 3 + [prose(rng, 200)] * 2
    passage = prose(rng, 450)
    texts += [prose(rng, rng.randint(0, 400)) + passage + prose(rng, rng.randint(0, 400)) for _ in range(25)]
    rng.shuffle(texts)
    check(spark, [(i if i % 7 else None, t) for i, t in enumerate(texts)])


def test_repeated_keys_and_empty(spark):
    rng = random.Random(3)
    a, b = prose(rng, 600), prose(rng, 800)
    check(spark, [(1, a), (1, a), (1, b), (2, b[100:700]), (None, b[:450])])
    check(spark, [(1, None)])
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert rp.repeated_passages(docs).count() == 0


def test_second_step_moves_no_text(spark, monkeypatch):
    """The anchors come with the texts: no join is left for the step that asks for most of them."""
    plans, arrow_map = [], rp.arrow_map

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return arrow_map(df, *args)

    monkeypatch.setattr(rp, "arrow_map", seen)
    rng = random.Random(17)
    passage = prose(rng, 700)
    check(spark, [(i, prose(rng, 300) + passage + prose(rng, 300)) for i in range(6)])
    assert len(plans) == 5  # anchors, three steps, what is removed
    assert "Join" not in plans[1] and "Exchange" not in plans[1]


def test_tables(spark):
    check(spark, [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()])
