import hashlib
import random
import re

import numpy as np

from passbook.llm import pii


def plain(text):
    """The fixed shapes by their patterns, with Python's own matching."""
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


PARTS = ["a.b@c.de", "x@y", "@@", "q@r.s@t.uv", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.002.3.4", "4111 1111 1111 1111",
         "4111-1111-1111-1112", "378282246310005", "+1 (456) 555-2186", "+12", "++49 30 1234567", "+1.2.3", "é", "word", " ", "-", "."]


def test_base_spans():
    rng = random.Random(2)
    for _ in range(4000):
        text = rng.choice(["", " ", "x"]).join(rng.choices(PARTS, k=rng.randint(0, 8)))
        assert pii.base_spans(text) == plain(text), text
    long = "a" * 300_000 + " @ " + "1" * 300_000 + ".1.1.1 " + "+1" + "(" * 100_000
    assert pii.base_spans(long) == []


def test_chain_chooses_best_segmentation():
    """Against all segmentations of a short stretch."""
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, 4)))
    text = "+1 (456) 55"
    tokens = next(pii.stretches(text))

    def every(i):
        if i == len(tokens):
            yield 0.0, []
            return
        for s, rest in every(i + 1):
            yield s, rest
        for j in range(i + 1, len(tokens) + 1):
            w = field.weights[pii.span_features(text, tokens[i][0], tokens[j - 1][1], j - i)].sum(axis=0)
            for s, rest in every(j):
                yield s + w.max() - pii.MARGIN, [(tokens[i][0], tokens[j - 1][1], pii.KINDS[int(w.argmax())]), *rest]

    assert field.label(text, tokens) == max(every(0), key=lambda x: x[0])[1]


def test_trained_field_finds_relatives():
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    samples = []
    for _ in range(60):
        samples += [f"call +1 ({digits(3)}) 555-{digits(4)} or", f"at u{digits(2)}.x@mail{digits(1)}.com now",
                    f"of 10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)} up", f"in {digits(4)} we", f"page {digits(2)} of {digits(3)}"]
    field = pii.fit(samples)
    hits = right = 0
    for _ in range(40):
        text = f"call +1 ({digits(3)}) 555-{digits(4)} or in {digits(4)} at z{digits(2)}@mail3.com"
        gold = pii.base_spans(text)
        found = [s for t in pii.stretches(text) for s in field.label(text, t)]
        hits += sum(s in found for s in gold)
        right += sum(s in gold for s in found)
    assert hits >= 76 and right >= 76


def test_odd_rows(spark):
    texts = [None, "", "a.b@c.de " * 2_000, "x a.b@c.de 1.2.3.4", "x a.b@c.de 1.2.3.4"]
    docs = spark.createDataFrame([(i % 3 or None, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = pii.scan(docs).collect()
    want = [(i % 3, hashlib.sha256(pii.written(plain(t or "")).encode()).hexdigest()) for i, t in enumerate(texts)]
    assert sorted((r.doc_id or 0, r.base_sha256) for r in got) == sorted(want)
    assert all(set(pii.written(plain(t or "")).split(",")) <= {x for r in got for x in r.spans.split(",")} for t in texts if t)
    assert pii.scan(docs.limit(0)).count() == 0


def test_long_lists_and_single_tokens():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    samples = [f"of 10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)} up" for _ in range(60)] + [f"in {digits(4)} we" for _ in range(60)]
    field = pii.fit(samples)
    text = " ".join(f"10.{rng.randint(0, 255)}.3.{rng.randint(0, 255)}" for _ in range(400))
    found = {s for t in pii.stretches(text) for s in field.label(text, t)}
    assert set(pii.base_spans(text)) <= found
    # a field that likes every token judges a number without separators too
    _, spans = pii.all_spans("call 5551234567 now", pii.Field(np.ones((pii.FEATURES, 4))))
    assert [s[:2] for s in spans] == [(5, 15)]
