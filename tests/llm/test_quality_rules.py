import random
import re

from passbook.llm import quality_rules as qr
from passbook.llm.common import table

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    marked = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)), len(marked), len(words) < 20 or 100 * len(marked) > 30 * len(words),
    )


def test_counts_against_plain_python(spark):
    rng = random.Random(1)
    words = ["a", "bb", "c#c", "é", " x", "😀", "|", "$", "A."]
    texts = [None, "", " ", "\n\n", "one", "\t one two \n", "a " * 8, "a " * 9, " ".join("abcdefgh") * 3]
    texts += ["".join(w + rng.choice([" ", "\n", "  ", "\r\n", "\x0b"]) for w in rng.choices(words[: rng.randint(1, 9)], k=rng.randint(1, 90))) for _ in range(150)]
    texts += ["same words here " * 60_000, " ".join(str(i) for i in range(100_000))]
    docs = spark.createDataFrame([(i % 100 or None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string")
    got = sorted(
        (r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in qr.quality(docs).collect()
    )
    assert got == sorted((i % 100, *plain(t)) for i, t in enumerate(texts))
    assert qr.quality(docs.limit(0)).count() == 0
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id or 0, r.n_words) for r in qr.quality(docs).filter("kept").collect())
    assert sorted((r.doc_id or 0, len(BLANK.findall(r.text))) for r in kept.collect()) == want


def test_verdicts_against_labels(spark):
    """The labels are not used; clean documents stay, most junk goes."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in qr.quality(table(spark, sf, "documents")).collect() if r.doc_id in truth and not r.base_failed]
    clean = [r.kept for r in rows if truth[r.doc_id]]
    junk = [r.kept for r in rows if not truth[r.doc_id]]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / max(1, len(junk)) < 0.2


def test_estimates_against_plain_loop(spark):
    rng = random.Random(2)
    names = [r[0] for r in qr.RULES]
    rows = {}
    for _ in range(400):
        good = rng.random() < 0.7
        v = tuple(rng.choice([0, 1 if good else -1, 1 if good else -1, -1 if good else 1]) for _ in names)
        rows[v] = rows.get(v, 0) + 1
    df = spark.createDataFrame([(*v, n) for v, n in rows.items()], [*(f"vote_{n}" for n in names), "n"])
    prior, rates = qr.estimate(df, rounds=3)
    p, q = qr.PRIOR, [qr.START] * len(names)
    for _ in range(3):
        post = {}
        for v in rows:
            odds = p / (1 - p)
            for rate, x in zip(q, v, strict=True):
                r = rate[x][0] / rate[x][1]
                odds *= max(1, r) if x == 1 else min(1, r) if x == -1 else 1
            post[v] = odds / (1 + odds)
        g = sum(post[v] * n for v, n in rows.items())
        b = sum((1 - post[v]) * n for v, n in rows.items())
        p = min(0.95, max(0.05, (g + 1) / (g + b + 2)))
        q = [
            {x: ((sum(post[v] * n for v, n in rows.items() if v[i] == x) + 1) / (g + 3),
                 (sum((1 - post[v]) * n for v, n in rows.items() if v[i] == x) + 1) / (b + 3)) for x in (1, -1, 0)}
            for i in range(len(names))
        ]
    assert abs(p - prior) < 1e-9
    assert all(abs(q[i][x][0] - rates[n][x][0]) < 1e-9 for i, n in enumerate(names) for x in (1, -1, 0))
