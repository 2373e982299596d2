import numpy as np

from passbook.llm import quality_classifier as qc
from passbook.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").select("doc_id", "quality")
    seen, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    weights = qc.train(qc.sample(docs, seen, "quality", "doc_id", "text", qc.MAX_LABELLED))
    rows = qc.classify(docs, weights, ["source", "lang"]).join(held.select("doc_id"), "doc_id").collect()
    truth = {r.doc_id: r.quality for r in held.collect()}
    right = sum(r.kept == bool(truth[r.doc_id]) for r in rows) / len(rows)
    clean = [r.kept for r in rows if truth[r.doc_id] == 1]
    assert right > 0.93 and sum(clean) / len(clean) > 0.97


def test_sites_shrink_by_hand(spark):
    """Against the same arithmetic in plain Python."""
    rows = [(i, "The cat sat." if i % 3 else "## ## ##", "a" if i % 4 else None, "p" if i % 5 else "q") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, host string, path string")
    w = np.zeros(qc.DENSE + qc.WORDS)
    w[3], w[0] = -2.0, 1.0
    got = {r.doc_id: r for r in qc.classify(docs, w, ["host", "path"]).collect()}
    p = {i: 1 / (1 + np.exp(-(qc.features(t) @ w))) for i, t, _, _ in rows}

    def groups(of):
        out = {}
        for i, _, h, q in rows:
            out.setdefault(of(h, q), []).append(p[i])
        return out

    def strength(child, parent):
        pm = {k: np.mean(v) for k, v in groups(parent).items()}
        excess = possible = 0.0
        up = {child(h, q): parent(h, q) for _, _, h, q in rows}
        for k, v in groups(child).items():
            m, n = pm[up[k]], len(v)
            excess += (sum(v) - n * m) ** 2 - n * m * (1 - m)
            possible += n * (n - 1) * m * (1 - m)
        return qc.MAX_STRENGTH if excess <= 0 else min(qc.MAX_STRENGTH, max(qc.MIN_STRENGTH, possible / excess - 1))

    top, host, path = (lambda h, q: 0), (lambda h, q: h), (lambda h, q: (h, q))
    prior = np.mean(list(p.values()))
    k1, k2 = strength(host, top), strength(path, host)
    s1 = {k: (sum(v) + k1 * prior) / (len(v) + k1) for k, v in groups(host).items()}
    s2 = {k: (sum(v) + k2 * s1[k[0]]) / (len(v) + k2) for k, v in groups(path).items()}
    for i, _, h, q in rows:
        odds = p[i] / (1 - p[i]) * s2[h, q] / (1 - s2[h, q]) * (1 - prior) / prior
        assert abs(got[i].quality - odds / (1 + odds)) < 1e-9


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "", "s", "x"), (1, "", "s", "x"), (2, "word " * 400_000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, evidence string")
    got = qc.classify(docs, np.zeros(qc.DENSE + qc.WORDS), ["source"])
    assert got.count() == 4 and {round(r.quality, 9) for r in got.collect()} == {0.5}
    assert qc.classify(docs.limit(0), np.zeros(qc.DENSE + qc.WORDS), ["source"]).count() == 0
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert not qc.train(qc.sample(docs, none, "quality", "doc_id", "text", 10)).any()


def test_sample_of_contradicting_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d")], "doc_id bigint, text string")
    labels = [(1, 1), (1, 0), (1, None), (2, 1), (2, 1), (None, 1), (3, None)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int")
    got = qc.sample(docs, frame, "quality", "doc_id", "text", 10).collect()
    assert sorted((r.doc_id, r.text, r.quality) for r in got) == [(1, "a", 0), (2, "b", 1)]
    assert qc.sample(docs, frame.limit(0), "quality", "doc_id", "text", 10).count() == 0
