"""Rule suggestions from uncategorised descriptions."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.functions.similarity import alike
from passbook.functions.text import GENERIC_TOKENS, first_nonempty, keyword, merchant_token
from passbook.operators.containment import contained
from passbook.operators.reports import uncategorized
from passbook.storage import cut

MIN_ROWS = 3


def tokens(ledger: DataFrame) -> DataFrame:
    """Uncategorised rows with their token; blank, generic and all-digit tokens are left out."""
    text = first_nonempty(F.col("cleaned_description"), F.col("original_description"))
    rows = uncategorized(ledger, without_merchant=True).withColumn("description", text)
    rows = rows.withColumn("token", merchant_token(F.col("description")))
    generic = F.col("token").isin(GENERIC_TOKENS)
    return rows.filter((F.col("token") != "") & ~generic & ~F.col("token").rlike(r"(?U)^\d+$"))


def token_groups(token_rows: DataFrame) -> DataFrame:
    """Size and sums per token, with the place a token takes in the merge order.

    ``rank`` sorts by size descending, then by the first row a token was seen in.
    """
    income = F.col("transaction_type") == "income"
    zero = F.lit(0).cast("decimal(12,2)")
    return token_rows.groupBy("token").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(~income, F.col("amount"))), zero).alias("spent"),
        F.coalesce(F.sum(F.when(income, F.col("amount"))), zero).alias("received"),
        F.min("transaction_date").alias("earliest"),
        F.max("transaction_date").alias("latest"),
        F.struct((-F.count("*")).alias("size"), F.min("id").alias("seen")).alias("rank"),
    )


def similar_pairs(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct tokens whose similarity is at least 80.

    At that similarity at most a fifth of the joint length t of two tokens is inserted or
    deleted.  Cut the shorter one into t/5 + 1 pieces: one of them survives unchanged in the
    other, moved by no more than t/5 places.  Tokens therefore meet by equality on (both
    lengths, piece number, piece), and only those pairs are compared.
    """
    w = words.select("token", F.length("token").alias("size")).distinct()
    joint = F.col("short") + F.col("long")
    edits = F.floor(joint / 5).cast("int")

    def with_pieces(sized):
        """piece number, its start in the shorter token and its length"""
        pieces = sized.withColumn("edits", edits).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        start = F.floor(F.col("piece") * F.col("short") / (F.col("edits") + 1)).cast("int")
        end = F.floor((F.col("piece") + 1) * F.col("short") / (F.col("edits") + 1)).cast("int")
        return pieces.withColumn("start", start).withColumn("width", end - start)

    as_short = w.withColumn("short", F.col("size")).withColumn(
        "long", F.explode(F.sequence(F.col("size"), F.floor(F.col("size") * 1.5).cast("int")))
    )
    offered = with_pieces(as_short).select(
        "short", "long", "piece",
        F.col("token").substr(F.col("start") + 1, F.col("width")).alias("text"),
        F.col("token").alias("a"),
    )
    as_long = w.withColumn("long", F.col("size")).withColumn(
        "short", F.explode(F.sequence(F.ceil(F.col("size") / 1.5).cast("int"), F.col("size")))
    )
    asked = (
        with_pieces(as_long)
        .withColumn("shift", F.explode(F.sequence(-F.col("edits"), F.col("edits"))))
        .withColumn("from", F.col("start") + F.col("shift"))
        .filter((F.col("from") >= 0) & (F.col("from") + F.col("width") <= F.col("long")))
        .select(
            "short", "long", "piece",
            F.col("token").substr(F.col("from") + 1, F.col("width")).alias("text"),
            F.col("token").alias("b"),
        )
        .distinct()
    )
    met = offered.join(asked, ["short", "long", "piece", "text"]).filter(F.col("a") != F.col("b"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.filter(alike(F.col("a"), F.col("b")))


def token_leaders(groups: DataFrame) -> DataFrame:
    """D16 token_merge: every token with the leader it joins.

    Taken by rank, a token joins the first earlier leader it resembles, else it leads itself.
    Each round settles the tokens whose earlier look-alikes are settled: a leader among them
    makes a follower, none left makes a leader.
    """
    ranks = groups.select("token", "rank")
    pairs = similar_pairs(groups)
    both = pairs.join(ranks.toDF("a", "a_rank"), "a").join(ranks.toDF("b", "b_rank"), "b")
    first = F.col("a_rank") < F.col("b_rank")
    edges = cut(
        both.select(
            F.when(first, F.col("a")).otherwise(F.col("b")).alias("before"),
            F.when(first, F.col("a_rank")).otherwise(F.col("b_rank")).alias("before_rank"),
            F.when(first, F.col("b")).otherwise(F.col("a")).alias("token"),
        )
    )
    # tokens that resemble no earlier one lead from the start
    later = edges.select("token").distinct()
    state = cut(
        ranks.join(later.withColumn("later", F.lit(True)), "token", "left").select(
            "token", F.when(F.col("later"), "open").otherwise("leader").alias("state")
        )
    )
    while not state.filter("state = 'open'").isEmpty():
        seen = (
            edges.join(state.toDF("before", "before_state"), "before")
            .groupBy("token")
            .agg(
                F.bool_or(F.col("before_state") == "leader").alias("has_leader"),
                F.bool_or(F.col("before_state") == "open").alias("has_open"),
            )
        )
        new = F.when(F.col("has_leader"), "follower").when(~F.col("has_open"), "leader").otherwise("open")
        state = cut(
            state.join(seen, "token", "left").select(
                "token", F.when(F.col("state") == "open", new).otherwise(F.col("state")).alias("state")
            )
        )
    leaders = state.filter("state = 'leader'").select(F.col("token").alias("before"))
    joined = (
        edges.join(leaders, "before")
        .join(state.filter("state = 'follower'").select("token"), "token")
        .groupBy("token")
        .agg(F.min_by("before", "before_rank").alias("leader"))
    )
    return joined.unionByName(leaders.select(F.col("before").alias("token"), F.col("before").alias("leader")))


def suggestion_stats(ledger: DataFrame) -> DataFrame:
    """Figures of every merged token group with at least three rows."""
    groups = cut(token_groups(tokens(ledger)))
    return _stats(groups, token_leaders(groups))


def _stats(groups: DataFrame, leaders: DataFrame) -> DataFrame:
    merged = (
        groups.join(leaders, "token")
        .groupBy(F.col("leader").alias("pattern"))
        .agg(
            F.sum("n").alias("transaction_count"),
            F.sum("spent").alias("spent"),
            F.sum("received").alias("received"),
            F.min("earliest").alias("earliest"),
            F.max("latest").alias("latest"),
            F.min_by("rank", F.when(F.col("token") == F.col("leader"), 0).otherwise(1)).alias("rank"),
        )
        .filter(F.col("transaction_count") >= MIN_ROWS)
    )
    net = (F.col("spent") - F.col("received")).cast("double")
    gross = (F.col("spent") + F.col("received")).cast("double")
    return merged.select(
        "pattern",
        "transaction_count",
        net.alias("total_amount"),
        (net / F.col("transaction_count")).alias("avg_amount"),
        F.date_format("earliest", "yyyy-MM-dd").alias("earliest"),
        F.date_format("latest", "yyyy-MM-dd").alias("latest"),
        (F.col("transaction_count") * F.lit(0.6) + gross / 1000 * F.lit(0.4)).alias("score"),
        "rank",
    )


def suggestions(ledger: DataFrame, limit: int = 20, samples: int = 5) -> DataFrame:
    """O7 top_suggestions: the best groups by score, each with its first distinct descriptions."""
    rows = tokens(ledger)
    groups = cut(token_groups(rows))
    leaders = cut(token_leaders(groups))
    order = [F.desc("score"), F.desc("transaction_count"), F.asc("rank")]
    top = cut(_stats(groups, leaders).orderBy(*order).limit(limit))
    # rows of a group come token by token in merge order
    first_seen = rows.groupBy("token", "description").agg(F.min("id").alias("id"))
    wanted = first_seen.join(
        leaders.join(top.select(F.col("pattern").alias("leader")), "leader"), "token"
    ).join(groups.select("token", F.col("rank").alias("token_rank")), "token")
    order_in = Window.partitionBy("leader").orderBy("token_rank", "id")
    picked = (
        wanted.withColumn("place", F.row_number().over(order_in))
        .filter(F.col("place") <= samples)
        .groupBy(F.col("leader").alias("pattern"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "description"))), lambda s: s["description"]).alias("sample_descriptions"))
    )
    return top.join(picked, "pattern").orderBy(*order).drop("rank")


def keyword_suggestions(ledger: DataFrame, min_matches: int = MIN_ROWS) -> DataFrame:
    """Keyword of every transaction with a merchant, and how many rows contain it.

    Descriptions are condensed to distinct texts, and keywords meet them by equality of
    pieces; keywords with fewer matches than asked for are left out.
    """
    text = first_nonempty(F.col("cleaned_description"), F.col("original_description"))
    word = F.when(F.coalesce("merchant_id", F.lit(0)) != 0, keyword(text))
    rows = ledger.select("id", "merchant_id", F.upper(text).alias("text"), word.alias("pattern"))
    asked = rows.filter(F.col("pattern").isNotNull())
    sizes = rows.groupBy("text").agg(F.count("*").alias("n"))
    matches = (
        contained(sizes, asked.select("pattern"))
        .join(sizes, "text")
        .groupBy("pattern")
        .agg(F.sum("n").alias("would_affect"))
        .filter(F.col("would_affect") >= min_matches)
    )
    return asked.join(matches, "pattern").select(
        F.col("id").alias("transaction_id"), F.col("pattern").alias("suggested_pattern"), "merchant_id", "would_affect"
    )
