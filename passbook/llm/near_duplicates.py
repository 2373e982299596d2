"""Near duplicates by an LSH forest over MinHash signatures.

A text's set are its distinct five-word shingles; texts with equal sets are one node.  The
signatures are sorted in several orders, each beginning at another place of the signature.
Nodes that share an order's first values form a region.  Neighbours in the sorted order share
the longest prefixes.  In a region of a few nodes all meet; in a large one a node meets the
next in the order, which agrees deepest.  Candidates are confirmed on the full sets, those that
met in most places first, one per node and round, then more; nodes that are in one component
already are not compared, as the components do not need it.

A region can also be too large, or cut between two tasks, for a node to meet all it may be linked
to.  The nodes of such regions go through an exact join on their rarest shingles.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm.common import WORD, row_names, sized
from passbook.llm.graph import components
from passbook.llm.ngram_join import similar_links
from passbook.llm.sets import across, confirmed, digest, document_components, hashes_of, mapped, mixed, nodes_of, shingles
from passbook.storage import cut

SHINGLE = 5
#: An order begins with PREFIX of the VALUES signature values and continues round the circle.
#: Sets with similarity 0.75 share no order's prefix with probability (1 - 0.75 ** 3) ** 24,
#: two in a million.
VALUES, ORDERS, PREFIX = 96, 24, 3
#: All nodes of a region of so many meet.
MEETING = 9
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: Candidates a node offers in the first round, and by how much more in each further one.
OFFERED, GROWTH = 1, 8

_random = np.random.default_rng(20240229)
FLIPS = _random.integers(0, 1 << 32, VALUES, dtype=np.uint32)
FACTORS = _random.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of VALUES hash functions."""
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    out = np.full(VALUES, 0xFFFF_FFFF, dtype=np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, ((low[i : i + 4096, None] ^ FLIPS) * FACTORS).min(axis=0), out=out)
    return out


def orders(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per signature and order: hash of the prefix, and the next four values' high halves."""
    at = np.arange(ORDERS) * (VALUES // ORDERS)
    prefix = np.broadcast_to(at.astype(np.uint64), (len(signatures), ORDERS)).copy()
    for j in range(PREFIX):
        prefix = mixed(prefix * np.uint64(0x9E3779B97F4A7C15) + signatures[:, (at + j) % VALUES])
    deeper = np.zeros((len(signatures), ORDERS), dtype=np.uint64)
    for j in range(PREFIX, PREFIX + 4):
        deeper = deeper << np.uint64(16) | (signatures[:, (at + j) % VALUES] >> np.uint32(16)).astype(np.uint64)
    return prefix.astype(np.int64), (deeper ^ np.uint64(1 << 63)).astype(np.int64)


def signed(own: DataFrame) -> DataFrame:
    """(key, n, s1, s2, prefix, deeper) of ``own`` (key, text): size and names of the set, and its place in each order."""

    def of(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, SHINGLE) for t in texts]
        names = [digest(s) for s in sets]
        prefix, deeper = orders(np.array([signature(s) for s in sets], dtype=np.uint32).reshape(-1, VALUES))
        return [[len(s) for s in sets], [n[0] for n in names], [n[1] for n in names], list(prefix), list(deeper)]

    return mapped(own, "key", "text", "n bigint, s1 bigint, s2 bigint, prefix array<bigint>, deeper array<bigint>", of)


def neighbours(entries: DataFrame) -> DataFrame:
    """(prefix, a, b, size): candidate pairs a < b, and, with ``size``, the regions to be looked at as a whole.

    The sorted order of ``entries`` (prefix, deeper, node) is cut into ranges over tasks, wherever
    it falls.  The first MEETING nodes of a region meet each other, later ones the node before.
    Each task names the regions at its two ends and those of more nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_prefix, last_node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        region, size, ended = None, 0, False  # the region at the end of what was read
        for batch in batches:
            new = batch.column("prefix").to_numpy()
            if not len(new):
                continue
            starts = np.nonzero(np.concatenate([[True], new[1:] != new[:-1]]))[0]
            sizes = np.diff(np.concatenate([starts, [len(new)]]))
            place = np.arange(len(new)) - np.repeat(starts, sizes)
            named = []
            if region is not None and new[0] == region:
                place[: sizes[0]] += size
                sizes[0] += size
            elif region is not None and (not ended or size > MEETING):
                named, ended = [(region, size)], True
            for r, n in zip(new[starts[:-1]].tolist(), sizes[:-1].tolist(), strict=True):
                if not ended or n > MEETING:
                    named.append((r, n))
                ended = True
            region, size = int(new[-1]), int(sizes[-1])
            old = len(last_prefix)
            prefix = np.concatenate([last_prefix, new])
            node = np.concatenate([last_node, batch.column("node").to_numpy()])
            place = np.concatenate([np.zeros(old, np.int64), place])
            out = []
            for apart in range(1, MEETING):
                at = np.nonzero(prefix[apart:] == prefix[:-apart])[0]
                at = at[at + apart >= old]
                if apart > 1:
                    at = at[place[at + apart] < MEETING]
                x, y = node[at], node[at + apart]
                out.append((prefix[at], np.minimum(x, y), np.maximum(x, y), np.zeros(len(at), np.int64)))
            yield made(*(np.concatenate(c) for c in zip(*out, strict=True)))
            yield regions(named)
            last_prefix, last_node = prefix[-MEETING:], node[-MEETING:]
        if region is not None:
            yield regions([(region, size)])

    def made(prefix, a, b, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(a), pa.array(b), pa.array(size)], ["prefix", "a", "b", "size"])

    def regions(named: list[tuple[int, int]]) -> pa.RecordBatch:
        none = np.zeros(len(named), np.int64)
        return made(np.array([r for r, _ in named], dtype=np.int64), none, none, np.array([n for _, n in named], dtype=np.int64))

    ranged = entries.repartitionByRange("prefix", "deeper", "node").sortWithinPartitions("prefix", "deeper", "node")
    return ranged.select("prefix", "node").mapInArrow(run, "prefix bigint, a bigint, b bigint, size bigint")


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Links (a, b) that join all components of ``pairs`` (a, b, votes) that are similar enough; None without one.

    In each round a node offers its candidates of other components with most votes.
    """
    found, labels, most = None, None, OFFERED
    left, known = pairs, sets.count()
    while True:
        open_ = left.count()
        both = left.select("a", "b", "votes", F.explode(F.array("a", "b")).alias("node"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "a", "b"))
        ranked = sized(both.withColumn("rank", rank), 2 * open_)
        offered = cut(sized(ranked.groupBy("a", "b", "votes").agg((F.min("rank") <= most).alias("now")), 2 * open_))
        new = confirmed(offered.filter("now"), sets, PERCENT, open_ + known)
        if not new.isEmpty():
            found = new if found is None else cut(found.union(new))
            labels = components(found)
        left = offered.filter("NOT now").drop("now")
        if labels is not None:
            left = across(left, labels).select("a", "b", "votes")
        left = cut(sized(left, open_ + known))
        if left.isEmpty():
            return found
        most *= GROWTH


def links(entries: DataFrame, sets_of) -> DataFrame:
    """(a, b): confirmed links that join all near-duplicate components.

    ``sets_of(ids)``: (node, hashes) of the ids (node).
    """
    near = cut(neighbours(entries))
    pairs = cut(near.filter("size = 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")))
    named = near.filter("size > 0").groupBy("prefix").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))
    whole = cut(named.filter((F.col("size") > MEETING) | ((F.col("parts") > 1) & (F.col("size") > 1))).select("prefix"))
    members = cut(entries.join(whole, "prefix", "left_semi").select("node").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(members).distinct()
    sets = cut(sets_of(wanted))
    found = met(pairs, sets)
    own = sets.join(members, "node", "left_semi").dropDuplicates(["node"])
    heads = cut(own.select("node", F.size("hashes").cast("bigint").alias("n"), F.col("hashes").alias("head")))
    return similar_links(heads, lambda ids: sets.join(ids, "node", "left_semi"), PERCENT, found, whole=True)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Rows that share a key are one document with several texts.  A text without words has no
    shingles and links with nothing.  A null key is its own component, null, and is kept.
    Other columns are left out.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = cut(signed(own).withColumn("row", F.monotonically_increasing_id()))
    nodes = nodes_of(rows)
    held = rows.withColumnRenamed("row", "node").join(nodes.select("node"), "node", "left_semi")
    entries = held.select("node", F.inline(F.arrays_zip("prefix", "deeper")))
    found = links(entries, lambda ids: hashes_of(own, nodes, ids, SHINGLE))
    done = document_components(rows, nodes, found)
    return done.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that have a near duplicate of a smaller key; equal texts under one key once."""
    gone = near_duplicates(docs, key, text).filter("NOT kept").select(F.col(key).alias("__gone")).distinct()
    left = docs.join(cut(gone), F.col(key) == F.col("__gone"), "left_anti")
    name, h1, h2 = row_names(key, text)
    having = docs.filter(F.col(key).isNotNull() & F.col(text).rlike(WORD))
    counts = having.groupBy(name.alias("__key"), h1.alias("__h1"), h2.alias("__h2")).agg(F.count(F.lit(1)).alias("__copies"))
    again = cut(counts.filter("__copies > 1").drop("__copies"))
    if again.isEmpty():
        return left
    same = (F.col(key) == F.col("__key")) & (h1 == F.col("__h1")) & (h2 == F.col("__h2"))
    once = left.join(again, same).dropDuplicates(["__key", "__h1", "__h2"]).select(docs.columns)
    return left.join(again, same, "left_anti").union(once)
