import random

from passbook.llm import decontaminate as dc
from passbook.llm.common import table


def test_planted(spark):
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    story = "A train leaves at 10 and Anna walks 10 km before it stops near the old mill where Anna rests for 3 hours and sings"
    other = "A train leaves at 25 and Peter walks 25 miles before it stops near the old mill where Peter rests for 7 days and sings"
    mixed = "A train leaves at 25 and Peter walks 26 miles before it stops near the old mill where Maria rests for 7 days and sings"
    items = [(1, story), (2, prose(40)), (3, "just five plain words here"), (4, "too short"), (5, None), (6, prose(40)), (6, "1 2 3 4 5 6 7 8 9")]
    docs = [
        (1, prose(50) + ". " + story + " " + prose(30)), (2, other), (3, mixed), (4, prose(300)), (5, None), (6, ""),
        (7, prose(20) + " " + items[1][1].upper()), (8, prose(9) + " just five plain\nwords here, " + prose(9)),
        (9, "x. " + " ".join(items[5][1].split()[:12])), (None, prose(3) + " " + items[5][1]), (10, "1 2 3 4 5 6 7 8 9"),
        (11, items[1][1]), (11, items[1][1]), (12, "te " * 100_000 + items[5][1]),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, hash string")
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, size string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(frame, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 3), (None, 6), (11, 2), (12, 6)}
    assert got[1, 1].kind == "exact" and got[2, 1].kind == "template" and got[2, 1].covered >= 20
    left = dc.drop_contaminated(frame, bench)
    assert left.columns == frame.columns
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 9, 10}
    assert dc.contaminated(frame.limit(0), bench).count() == 0
    assert dc.contaminated(frame, bench.limit(0)).count() == 0


def test_whole_passages_of_the_tables(spark):
    """Against a plain search for the whole items; what else is found covers half an item."""
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if i.text in d.text}
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, items).collect()}
    assert want and want <= set(got)
    assert len(set(got) - want) <= 0.2 * len(want)


def test_copies_in_other_case_and_of_numbers(spark):
    """Whole copies whose windows are mostly slots on one side, and templates quoted inside a sentence."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(1, prose(40)), (2, "What is 12 * 45 + 3?"), (3, "Did Anna, Peter or Maria Smith drive 12 km in 3 hours and 20 minutes on Monday"),
             (4, "What is the name of it"), (5, prose(12) + " 12 km and " + prose(12)), (6, "What do 30 of the cats eat")]
    docs = [
        (1, prose(20) + " " + items[0][1].upper()), (2, prose(20) + " " + items[0][1].title() + " " + prose(9)), (3, "x. " + items[1][1]),
        (4, "he asked: " + prose(3) + " What is 12 * 45 + 3 " + prose(4)), (5, prose(5) + " " + items[2][1] + " " + prose(5)),
        (6, prose(7) + ' asked, "What is the name of it'), (7, items[4][1].replace("12", "77").upper()), (8, prose(40).upper()),
        (9, "What is 12 * 46 + 3?"), (10, "1 2 3 4 5 6 7 8 9"), (11, prose(4) + ', "What do 45 of the cats eat'),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in dc.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    exact = {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4)}
    assert got == {k: "exact" for k in exact} | {(7, 5): "template", (11, 6): "template"}


def test_rows_go_by_their_own_text(spark):
    """Clean rows under the key of a contaminated one stay; texts under one key do not add up."""
    rng = random.Random(6)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    item = prose(40)
    words = item.split()
    clean, bad = [prose(30) for _ in range(4)], prose(5) + " " + item
    halves = [" ".join(words[:14]), " ".join([*prose(14).split(), *words[14:28]])]
    rows = [(None, bad), (None, clean[0]), (None, clean[1]), (1, bad), (1, clean[2]), (1, None), (2, halves[0]), (2, halves[1]), (3, clean[3])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, item)], "item_id bigint, text string")
    left = {tuple(r) for r in dc.drop_contaminated(frame, bench).collect()}
    assert left == {r for r in rows if r[1] != bad}
    assert {r.doc_id for r in dc.contaminated(frame, bench).collect()} == {None, 1}


def test_parallel_sentences_and_inserted_words(spark):
    """Items that repeat their windows, and copies whose halves lie on two diagonals."""
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    farms = [("1990", "Anna", "30"), ("1995", "Peter", "40"), ("1997", "Maria", "55"), ("2001", "Paul", "61"), ("2004", "Clara", "72"), ("2010", "Otto", "88")]
    said = [f"In {y} the farm of {n} sold {c} boxes." for y, n, c in farms]
    short, long = prose(38).split(), prose(200).split()
    items = [(1, " ".join(said)), (2, " ".join(short)), (3, " ".join(long))]
    docs = [
        (1, prose(20) + ". " + " ".join(said) + " " + prose(5)), (2, prose(9) + ". " + said[2]),
        (3, " ".join(short[:14] + ["inserted"] + short[14:26] + prose(12).split())),
        (4, " ".join(short[:14] + prose(200).split() + short[14:26])), (5, "te " * 5000),
        (6, " ".join(f"In 18{y[2:]} the farm of {n}x sold 1{c} boxes." for y, n, c in farms)),
    ]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(frame, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert set(got) == {(1, 1), (3, 2), (6, 1)} and got[6, 1].kind == "template"
    assert got[1, 1].covered == 54 and got[1, 1].kind == "exact" and got[3, 2].covered == 26
