import random

import corpus_pipeline as cp
from test_near_duplicates import brute, edited
from test_packing import check
from test_quality_rules import plain


def test_stages_take_effect(spark, tmp_path):
    """Junk, copies, benchmark passages and secrets planted among clean prose; brute force per stage."""
    rng = random.Random(4)

    def prose(n):
        words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(n)]
        return " ".join(w.capitalize() if i % 9 == 0 else w + "." * (i % 9 == 8) for i, w in enumerate(words)) + "."

    clean = [prose(rng.randint(40, 200)) for _ in range(60)]
    item = prose(40)
    junk = [" ".join(w + rng.choice(["###", "&&&", "%%%"]) for w in prose(60).split()) for _ in range(12)]
    texts = clean + [edited(rng, clean[0], 1), clean[1]] + [prose(30) + " " + item + " " + prose(30)] + junk + ["short", None, ""]
    texts += [prose(40) + " password = 'abc12345xyz' " + prose(20)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert i == 4 or out.columns == docs.columns
        out.write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        kept[name] = docs.collect()
    texts_of = {n: {r.doc_id: r.text for r in rows} for n, rows in kept.items() if n != "packing"}
    passed = texts_of["quality rules"]
    assert not any(plain(t)[-1] for t in passed.values()) and set(range(60)) <= set(passed)
    assert not {i for i, t in enumerate(texts) if t in junk} & set(passed)
    component = brute(list(passed.items()))
    assert set(texts_of["near duplicates"]) == {k for k in passed if component[k] == k}
    after = texts_of["decontamination"]
    assert set(texts_of["near duplicates"]) - set(after) == {62}
    final = texts_of["secrets"]
    assert set(final) == set(after) and {k for k in after if final[k] != after[k]} == {len(texts) - 1}
    assert "[SECRET]" in final[len(texts) - 1] and "abc12345xyz" not in final[len(texts) - 1]
    check(kept["packing"], final)
    assert sorted(map(tuple, cp.run(spark, sf).select("doc_id", "start", "ids_crc32").collect())) == sorted(
        (r.doc_id, r.start, r.ids_crc32) for r in kept["packing"]
    )
