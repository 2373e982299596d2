import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import Row
from tokenizers import Tokenizer

from passbook.llm import packing

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, texts):
    """Every id in one piece with its checksum; sequences without gaps, at most two not full."""
    tokenizer = Tokenizer.from_file(PATH)
    pieces, boxes = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        boxes[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for key, text in texts.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[key], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes()) == r.ids_crc32
        assert at == len(ids)
    assert set(boxes) == set(range(len(boxes)))
    short = 0
    for box in boxes.values():
        at = 0
        for r in sorted(box, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
        short += at < packing.WINDOW
    assert short <= 2


def test_round_trip(spark):
    rng = random.Random(5)
    words = "the thing über, «ñ» don't 1234 it's\tfoo\n bar_baz ##%% 漢字 x y   <|endoftext|> 😀".split(" ")
    texts = {i: " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 41, 41, 41, 300, 2500]))) for i in range(150)}
    texts[150], texts[151], texts[152] = None, "", " lead  double \n\n end "
    texts[153] = "wort " * 60_000
    texts |= {i: "same text of one length " * 9 for i in range(200, 260)}
    rows = [Row(doc_id=i, text=t, size=i, part="clash", task=None) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size bigint, part string, task string")
    check(packing.pack(docs.repartition(5), PATH).collect(), texts)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c")], "doc_id bigint, text string")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows if r.start == 0) == [(0, 4), (0, 4), (7, 4)]
    assert packing.pack(docs.limit(0), PATH).collect() == []


def test_combinations_use_the_histogram_up():
    histogram = {12: 1000, 20: 1000, 10: 600, 22: 300, 5: 7}
    used = defaultdict(int)
    for combo, n in packing.plan(histogram, 32):
        assert sum(combo) == 32
        for size in combo:
            used[size] += n
    assert all(used[s] <= n for s, n in histogram.items())
    assert used[12] + used[20] >= 1900 and used[22] + used[10] >= 700


def test_encoder_of_any_file():
    """Files that normalise or split otherwise give their own ids too."""
    texts = ["", "Plain text, it's 12 o'clock.", "two  spaces\tand\n\nlines ", "ÉTÉ naïve 123456 \u4f60\u597d", " x" * 500]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = f"/opt/tokenizers/{name}"
        plain = Tokenizer.from_file(path)
        assert packing.plain_bytes(path) == name.startswith("byte")
        for text in texts:
            got = np.frombuffer(packing.Encoder(path).encode(text), "<u4").tolist()
            assert got == plain.encode(text, add_special_tokens=False).ids
