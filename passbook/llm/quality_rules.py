"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good, bad or abstains.  Which documents are good is not known: expectation
maximisation over the table of vote patterns estimates how often each rule votes how on good
and on bad documents, and a document is kept if its posterior probability of being good is
high enough.  There are at most 3 ** rules patterns, however many documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.compute import settled
from passbook.llm.common import SPACE, WORD, hidden, shown
from passbook.storage import cut

#: Name, score (Column over the features), bad from this on, good up to this.  Where good is
#: larger than bad, high scores are good.  In between the rule abstains.
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", 0.03, 0.005),
    ("copied_lines", "n_dup_lines / greatest(n_lines, 1)", 0.3, 0.05),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.2, 0.02),
    ("capitals", "n_capitals / greatest(word_chars, 1)", 0.3, 0.08),
    ("exclamations", "n_exclamations / greatest(n_words, 1)", 0.2, 0.02),
    ("distinct_words", "n_distinct_words / greatest(n_words, 1) * least(1.0, n_words / 50.0) + greatest(0.0, 1 - n_words / 50.0)", 0.2, 0.45),
    ("word_length", "abs(word_chars / greatest(n_words, 1) - 5.5)", 4.0, 2.0),
    ("stops", "n_stops / greatest(n_words, 1)", 0.005, 0.03),
    ("letters", "n_letters / greatest(word_chars, 1)", 0.85, 0.93),
    ("plain_words", "n_plain_words / greatest(n_words, 1)", 0.75, 0.9),
]
#: Letters, at most one hyphen or apostrophe among them, at most one mark behind.
PLAIN_WORD = r"^\p{L}++(?:['’\-]\p{L}*+)?[.,;:!?]?$"
ROUNDS = 12
PRIOR = 0.8
#: How often a rule votes how on good and on bad documents, to begin with: a bad vote says
#: much, the want of a symptom little.
START = {1: (0.9, 0.6), -1: (0.02, 0.3), 0: (0.08, 0.1)}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts the rules use, each worked out once per row.

    A null text counts as empty.  Words and windows of eight words are compared by 64-bit hashes;
    a text's words inside its repeated windows are counted from sorted positions, so the work
    grows with n log n of its own words and needs no shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = settled(docs, __t=t, __w=F.btrim(t, F.lit(" \t\n\x0b\f\r")))
    words = F.when(F.col("__w") != "", F.split("__w", f"{SPACE}+", -1)).otherwise(F.array().cast("array<string>"))
    df = settled(df, __w=words, __l=F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(WORD)))
    df = settled(
        df,
        __h=F.transform("__w", lambda w: F.xxhash64(w)),
        word_chars=F.length(F.regexp_replace("__t", f"{SPACE}+", "")).cast("long"),
        n_lines=F.size("__l").cast("long"),
        n_symbols=_count(r"[^#*$%&|<>]+"),
        n_capitals=_count(r"\P{Lu}+"),
        n_exclamations=_count(r"[^!]+"),
        n_stops=_count(r"[^.,;:?]+"),
        n_letters=_count(r"\P{L}+"),
        n_plain_words=F.size(F.filter("__w", lambda w: w.rlike(PLAIN_WORD))).cast("long"),
        n_dup_lines=(F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
    ).drop("__t", "__w", "__l")
    df = settled(
        df,
        __d=F.size(F.array_distinct("__h")),
        n_words=F.size("__h").cast("long"),
    )
    df = settled(df, n_distinct_words=F.col("__d").cast("long"))
    # hashes of two, four and eight words from those of their halves; eight words that come
    # again bring so many shorter windows that come again, and without these there are none
    for by in (1, 2, 4):
        n = F.greatest(F.size("__h") - by, F.lit(0))
        joined = F.zip_with(F.slice("__h", 1, n), F.slice("__h", by + 1, n), lambda a, b: F.xxhash64(a, b))
        possible = F.size("__h") - F.col("__d") >= 9 - by
        df = settled(df, __h=F.when(possible, joined).otherwise(F.array().cast("array<bigint>")))
        df = settled(df, __d=F.size(F.array_distinct("__h")))
    # only texts with a window twice need the positions: they take the place of a hash's last
    # bits, and windows that agree in the other bits are looked at again
    df = settled(df, __m=F.when(F.col("__d") < F.size("__h"), F.expr("shiftleft(1L, cast(ceil(log2(size(__h))) AS int)) - 1")))
    df = settled(df, __s=F.expr("if(__m IS NULL, array(), sort_array(transform(__h, (h, i) -> (h & ~__m) | i)))").cast("array<bigint>"))
    near = "filter(__s, (x, j) -> (x ^ get(__s, j - 1)) & ~__m = 0 OR (x ^ get(__s, j + 1)) & ~__m = 0)"
    pairs = f"sort_array(transform({near}, x -> struct(__h[cast(x & __m AS int)] AS h, cast(x & __m AS int) AS i)))"
    df = settled(df, __s=F.expr(pairs)).drop("__h", "__d", "__m")
    again = "filter(__s, (x, j) -> x.h = get(__s, j - 1).h OR x.h = get(__s, j + 1).h)"
    df = settled(df, __p=F.expr(f"sort_array(transform({again}, x -> x.i))")).drop("__s")
    covered = "transform(__p, (p, j) -> least(8, coalesce(get(__p, j + 1), p + 8) - p))"
    return settled(
        df, n_repeat_words=F.expr(f"coalesce(aggregate({covered}, 0L, (a, x) -> a + x), 0L)")
    ).drop("__p")


def _count(others: str) -> Column:
    """Characters left when all ``others`` are taken out."""
    return F.length(F.regexp_replace("__t", others, "")).cast("long")


def votes(df: DataFrame) -> DataFrame:
    """``df`` with one column per rule: 1 good, -1 bad, 0 abstains."""
    cast = {}
    for name, score, bad, good in RULES:
        s = F.expr(score)
        low, high = (bad, good) if good > bad else (good, bad)
        side = F.when(s <= low, -1 if good > bad else 1).when(s >= high, 1 if good > bad else -1).otherwise(0)
        cast[f"vote_{name}"] = side.cast("int")
    return settled(df, **cast)


Accuracies = dict[str, dict[int, tuple[float, float]]]


def posterior(prior: float, rates: Accuracies) -> Column:
    """Probability of good given the votes; ``rates[rule][vote]``: how often in good and in bad.

    Rules are taken to be no worse than chance: a vote never speaks against what it says.
    Who abstains says nothing.
    """
    odds = F.lit(prior / (1 - prior))
    for name, by_vote in rates.items():
        vote = F.col(f"vote_{name}")
        ratio = {v: g / b for v, (g, b) in by_vote.items()}
        odds = odds * F.when(vote == 1, max(1.0, ratio[1])).when(vote == -1, min(1.0, ratio[-1])).otherwise(1.0)
    return odds / (1 + odds)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[float, Accuracies]:
    """Prior and vote rates by expectation maximisation over (votes, n).

    Starts from START for every rule.  Each round is an aggregation of the
    small pattern table to one row.  Rates are smoothed by one vote of each kind, and the
    prior stays between 0.05 and 0.95.
    """
    names = [r[0] for r in RULES]
    prior, rates = PRIOR, {n: START for n in names}
    for _ in range(rounds):
        weighed = patterns.withColumn("__p", posterior(prior, rates))
        good, bad = F.col("__p") * F.col("n"), (1 - F.col("__p")) * F.col("n")
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for n in names:
            for v in (1, -1, 0):
                is_v = F.col(f"vote_{n}") == v
                sums += [F.sum(F.when(is_v, good)).alias(f"g_{n}_{v}"), F.sum(F.when(is_v, bad)).alias(f"b_{n}_{v}")]
        row = weighed.agg(*sums).first()
        g, b = row["good"] or 0.0, row["bad"] or 0.0
        prior = min(0.95, max(0.05, (g + 1) / (g + b + 2)))
        rates = {
            n: {v: (((row[f"g_{n}_{v}"] or 0) + 1) / (g + 3), ((row[f"b_{n}_{v}"] or 0) + 1) / (b + 3)) for v in (1, -1, 0)}
            for n in names
        }
    return prior, rates


def judged(voted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Voted rows with base_failed, quality (the posterior) and kept.

    What fails the base rules is settled; the estimates are made on the others.
    """
    names = [f"vote_{r[0]}" for r in RULES]
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    patterns = cut(voted.filter(~failed).groupBy(names).agg(F.count(F.lit(1)).alias("n")))
    prior, rates = estimate(patterns)
    df = voted.withColumns({"base_failed": failed, "quality": posterior(prior, rates)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words and the other counts, votes, base_failed, quality, kept) of every row.

    Null keys and equal rows are judged like others; columns besides key and text are left out.
    """
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return judged(cut(votes(features(own, "__text")).drop("__text"))).withColumnRenamed("__key", key)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns.

    Votes are worked out once and written together with the rows, which costs less than to
    work them out again for the verdicts; nothing is shuffled but the vote patterns.
    """
    voted = cut(votes(features(hidden(docs, text), "__in")).drop("__in"))
    return shown(judged(voted).filter("kept"), docs.columns)
