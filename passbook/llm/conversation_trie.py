"""Prefix tries of conversations as double arrays, one per shard of prefixes.

Turns become hashes, and positions come from a range-sorted order that cuts long conversations
wherever it falls.  From its first turn on that no other conversation has at the same depth, a
conversation is a chain of nodes of its own; these nodes are made row by row.  What is left, the
heads that may be shared, become one row each, and equal heads one row.

A prefix that more than LIMIT distinct heads share is an upper node.  Below the upper nodes, the
heads fall into shards by their first prefix that is none.  A shard gives its turns dense ids,
packs its trie into BASE and CHECK arrays, walks every head through them for the nodes' members,
and adds up leaves and tokens from the deepest nodes to the shard's tops by CHECK.  The few
upper nodes are then merged from all shards' tops by grouped sums.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from passbook.storage import cut

#: A prefix of more distinct heads than this (1 at least) is split by the turns below it; heads a shard holds on average.
LIMIT, SHARD = 20_000, 20_000
#: A conversation takes up to GROUP_TURNS first turns of the first conversation of its group of GROUP.
GROUP, GROUP_TURNS = 5, 8


def positions(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, pos, t1, t2, bytes): every turn's place in its conversation from 0, its hashes and the text's bytes.

    The rows are sorted over all tasks, so a conversation of any length is cut into stretches;
    a stretch's offset is what earlier tasks have of the conversation.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("c"),
        F.col(turn).alias("turn"),
        F.xxhash64(who, said).alias("t1"),
        F.xxhash64(F.lit("turn"), said, who).alias("t2"),
        F.octet_length(said).cast("bigint").alias("bytes"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            starts = np.nonzero(np.concatenate([[True], c[1:] != c[:-1]]))[0]
            sizes = np.diff(np.concatenate([starts, [len(c)]]))
            at = np.arange(len(c)) - np.repeat(starts, sizes)
            if c[0] == last:
                at[: sizes[0]] += seen
            last, seen = c[-1], int(at[-1]) + 1
            own = [batch.column("c"), pa.array(np.full(len(c), task)), pa.array(at)]
            yield pa.RecordBatch.from_arrays([*own, *(batch.column(n) for n in ("t1", "t2", "bytes"))], names)

    names = ["c", "part", "at", "t1", "t2", "bytes"]
    ranged = rows.repartitionByRange("c", "turn", "t1", "t2").sortWithinPartitions("c", "turn", "t1", "t2")
    stretches = cut(ranged.mapInArrow(run, ", ".join(f"{n} bigint" for n in names)))
    per_part = stretches.groupBy("c", "part").agg((F.max("at") + 1).alias("n"))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations that a cut of the sorted order runs through
    later = per_part.withColumn("first", F.sum("n").over(before)).filter("first IS NOT NULL").select("c", "part", "first")
    joined = stretches.join(cut(later), ["c", "part"], "left")
    return joined.select("c", (F.col("at") + F.coalesce("first", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, len) of every conversation, and (c, d, t1, t2, bytes) of its rebuilt turns, d from 1.

    A conversation c begins with the first h turns of conversation c - c % GROUP, and goes on
    with its own turns after its first h; h is a checksum of c up to GROUP_TURNS.
    """
    sizes = cut(turns.groupBy("c").agg((F.max("pos") + 1).alias("n")))
    h = F.crc32(F.col("c").cast("string")) % (GROUP_TURNS + 1)
    base = F.expr(f"c - c % {GROUP}")
    convs = sizes.withColumns({"h": h, "base": base})
    given = convs.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("base_n")), "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = cut(given.select("c", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")))

    own = turns.join(convs, "c").filter("pos >= h").select("c", F.expr("taken + pos - h + 1").alias("d"), "t1", "t2", "bytes")
    first = turns.filter(f"pos < {GROUP_TURNS} AND c % {GROUP} = 0")
    to = first.withColumn("to", F.explode(F.expr(f"transform(sequence(-{GROUP - 1}, {GROUP - 1}), k -> try_add(c, cast(k AS bigint)))")))
    to = to.filter(f"`to` - `to` % {GROUP} = c").select(F.col("to").alias("c"), "pos", "t1", "t2", "bytes")
    lent = to.join(convs, "c").filter("pos < taken").select("c", F.expr("pos + 1").alias("d"), "t1", "t2", "bytes")
    return convs.select("c", "len"), cut(own.union(lent))


def with_keys(heads: DataFrame) -> DataFrame:
    """``heads`` (c, len, head) with k1, k2: the two hashes that name each prefix, the empty one (0, 0) first."""
    schema = "c bigint, len bigint, t1 array<bigint>, t2 array<bigint>, bytes array<bigint>, k1 array<bigint>, k2 array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1s, k2s = [], []
            t1s, t2s = batch.column("t1").to_pylist(), batch.column("t2").to_pylist()
            for t1, t2 in zip(t1s, t2s, strict=True):
                digest, keys = b"", [(0, 0)]
                for pair in np.array([t1, t2], dtype=np.int64).T:
                    digest = hashlib.blake2b(digest + pair.tobytes(), digest_size=16).digest()
                    keys.append(tuple(np.frombuffer(digest, np.int64).tolist()))
                k1s.append([k[0] for k in keys])
                k2s.append([k[1] for k in keys])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (t1s, t2s, batch.column("bytes").to_pylist(), k1s, k2s)]
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("len"), *lists], ["c", "len", "t1", "t2", "bytes", "k1", "k2"])

    return heads.mapInArrow(run, schema)


class DoubleArray:
    """A trie over symbols from 1 on: state s goes by symbol x to BASE[s] + x, if CHECK there is s."""

    TRIES = 64

    def __init__(self, words: list[tuple[int, ...]]):
        """``words``: sorted, distinct, not empty."""
        self.base, self.check = [0], [0]
        self.free = 1
        todo = [(0, 0, len(words), 0)] if words else []
        while todo:
            state, lo, hi, depth = todo.pop()
            cuts, labels = [], []
            for i in range(lo, hi):
                if len(words[i]) > depth and (not labels or words[i][depth] != labels[-1]):
                    labels.append(words[i][depth])
                    cuts.append(i)
            if not labels:
                continue
            self.base[state] = at = self._fit(labels)
            for label, a, b in zip(labels, cuts, [*cuts[1:], hi], strict=True):
                self.check[at + label] = state
                todo.append((at + label, a, b, depth + 1))

    def _room(self, n: int):
        more = n - len(self.check)
        if more > 0:
            self.check += [-1] * max(more, len(self.check))
            self.base += [0] * (len(self.check) - len(self.base))

    def _fit(self, labels: list[int]) -> int:
        """A base at which all labels fall on unused places: the first of a few tries, else behind all."""
        check = self.check
        while self.free < len(check) and check[self.free] >= 0:
            self.free += 1
        at, span = self.free, labels[-1] - labels[0]
        for _ in range(self.TRIES):
            self._room(at + span + 1)
            if all(check[at - labels[0] + x] < 0 for x in labels):
                return at - labels[0]
            at += 1
            while at < len(check) and check[at] >= 0:
                at += 1
        at = len(check)
        self._room(at + span + 1)
        return at - labels[0]

    def walk(self, word: tuple[int, ...]) -> Iterator[int]:
        """The states a word goes through, the root left out; it ends where no transition is."""
        state = 0
        for x in word:
            to = self.base[state] + x
            if not 0 < to < len(self.check) or self.check[to] != state:
                return
            yield to
            state = to


#: A shard's nodes; ``up``: places of the head's keys that are upper nodes, for the shard's tops only.
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends bigint, end_conv bigint, k1 bigint, k2 bigint, up1 array<bigint>, up2 array<bigint>"
)


def shard_nodes(shard: pa.Table) -> pa.Table:
    """The nodes of one shard's heads from their depth ``s`` on."""
    rows = shard.select(["least", "members", "below", "s", "t1", "t2", "bytes", "k1", "k2"]).to_pylist()
    ids: dict[tuple[int, ...], int] = {}
    words = []
    rows.sort(key=lambda r: (r["k1"][r["s"]], r["k2"][r["s"]], r["t1"], r["t2"]))
    for r in rows:
        s = r["s"]
        turns = [(r["k1"][s], r["k2"][s], s), *zip(r["t1"][s:], r["t2"][s:], strict=True)]
        words.append(tuple(ids.setdefault(t, len(ids) + 1) for t in turns))
    trie = DoubleArray(sorted(set(words)))
    size = len(trie.check)
    parent = np.array(trie.check)
    n_convs, ends, below, depth = (np.zeros(size, dtype=np.int64) for _ in range(4))
    least, end_conv = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).max)
    holder = np.full(size, -1)
    for i, (r, word) in enumerate(zip(rows, words, strict=True)):
        state = 0
        for d, state in enumerate(trie.walk(word), r["s"]):
            n_convs[state] += r["members"]
            least[state] = min(least[state], r["least"])
            depth[state], holder[state] = d, i
        if r["below"]:
            below[state] = 1  # the rest of this conversation is its own
        else:
            ends[state] += r["members"]
            end_conv[state] = min(end_conv[state], r["least"])
    states = np.nonzero(holder >= 0)[0]
    top = depth[states] == np.array([rows[i]["s"] for i in holder[states]])
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    inner = states[~top]
    np.add.at(children, parent[inner], 1)
    children += below
    last_bytes = np.array([rows[i]["bytes"][d - 1] for i, d in zip(holder[states], depth[states], strict=True)], dtype=np.int64)
    saved[states] = (n_convs[states] - 1) * last_bytes
    leaves[states] = (children[states] == 0) | (below[states] > 0)
    for d in np.unique(depth[inner])[::-1]:
        level = inner[depth[inner] == d]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    up = [(rows[i]["k1"][:d], rows[i]["k2"][:d]) if t else (None, None) for i, d, t in zip(holder[states], depth[states], top, strict=True)]
    at = [(rows[i]["k1"][d], rows[i]["k2"][d]) for i, d in zip(holder[states], depth[states], strict=True)]
    numbers = [least[states], depth[states], None, n_convs[states], children[states], leaves[states], saved[states], ends[states]]
    arrays = [pa.array(least[parent[states]], mask=top) if n is None else pa.array(n, pa.int64()) for n in numbers]
    arrays.append(pa.array(end_conv[states], mask=ends[states] == 0))
    arrays += [pa.array([k[j] for k in at], pa.int64()) for j in (0, 1)]
    arrays += [pa.array([u[j] for u in up], pa.list_(pa.int64())) for j in (0, 1)]
    return pa.Table.from_arrays(arrays, [f.split()[0] for f in NODES.split(", ")])


def digests(members: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, c): the hash of the decimal c, ascending, comma-joined.

    A node's members stream through one task in order, as the hash asks for; nothing is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            out = []
            for k1, k2, c in zip(*(batch.column(n).to_pylist() for n in ("k1", "k2", "c")), strict=True):
                if (k1, k2) == name:
                    state.update(f",{c}".encode())
                else:
                    if name is not None:
                        out.append((*name, state.hexdigest()))
                    name, state = (k1, k2), hashlib.sha256(str(c).encode())
            yield made(out)
        if name is not None:
            yield made([(*name, state.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["k1", "k2", "ends_sha256"])

    dealt = members.select("k1", "k2", "c").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "c")
    return dealt.mapInArrow(run, "k1 bigint, k2 bigint, ends_sha256 string")


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_nodes(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Turns are ordered by ``turn``, null first; rows of an equal turn by a hash of role and text,
    one by one.  A null role or text is empty; rows with a null id belong to no conversation.
    Without conversations there is no node.  Ids are whole numbers; other columns are left out.
    Turns and prefixes are compared by 128-bit hashes.
    """
    if not isinstance(conversations.schema[conv_id].dataType, IntegralType):
        raise TypeError(f"{conv_id} must be a whole number")
    turns = cut(positions(conversations, conv_id, turn, role, text))
    convs, rows = rebuilt(turns)

    alone = rows.groupBy("d", "t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).filter("n = 1")
    own_from = cut(alone.groupBy("c").agg(F.min("d").alias("u")))
    split = rows.join(own_from, "c", "left")
    head = split.filter("u IS NULL OR d <= u").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("d", "t1", "t2", "bytes"))).alias("h"))
    empty = F.expr("cast(array() AS array<bigint>)")
    parts = [F.coalesce(F.col(f"h.{n}"), empty).alias(n) for n in ("t1", "t2", "bytes")]
    heads = cut(with_keys(convs.join(head, "c", "left").select("c", "len", *parts)))
    last = {"e1": F.element_at("k1", -1), "e2": F.element_at("k2", -1), "below": F.col("len") - F.size("t1")}
    ended = heads.withColumns(last)

    # equal heads are one; one that goes on by itself is no other's equal
    equal = cut(ended.groupBy("e1", "e2").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("members")))
    distinct = ended.join(equal.select("c", "members"), "c").withColumnRenamed("c", "least")
    prefixes = distinct.select("least", F.posexplode(F.arrays_zip("k1", "k2")).alias("depth", "k"))
    shared = prefixes.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    upper = shared.filter(F.col("n") > LIMIT).select("k", "depth").filter("depth > 0")
    deepest = prefixes.select("least", "k").join(cut(upper), "k").groupBy("least").agg(F.max("depth").alias("deepest"))
    s = (F.coalesce("deepest", F.lit(0)) + 1).cast("bigint").alias("s")
    placed = cut(distinct.join(cut(deepest), "least", "left").select(*distinct.columns, s))

    shards = max(int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions")), placed.count() // SHARD + 1)
    deep = placed.filter("size(t1) >= s")
    top_key = F.xxhash64(F.element_at("k1", (F.col("s") + 1).cast("int")), F.element_at("k2", (F.col("s") + 1).cast("int")))
    nodes = cut(deep.withColumn("shard", F.pmod(top_key, F.lit(shards))).groupBy("shard").applyInArrow(shard_nodes, NODES))

    # the upper nodes: members from the heads, sums from the shards' tops
    ups = F.arrays_zip(F.slice("k1", 1, F.col("s").cast("int")).alias("k1"), F.slice("k2", 1, F.col("s").cast("int")).alias("k2"))
    above = placed.select("least", "members", "bytes", F.size("t1").alias("size"), ups.alias("path"), F.posexplode(ups).alias("depth", "k"))
    here = F.col("size") == F.col("depth")
    tops = nodes.filter("up1 IS NOT NULL")
    member = above.groupBy("k").agg(
        F.max("depth").cast("bigint").alias("depth"),
        F.min("least").alias("conv_id"),
        F.sum("members").alias("n_convs"),
        F.coalesce(F.sum(F.when(here, F.col("members"))), F.lit(0)).alias("ends"),
        F.min(F.when(here, F.col("least"))).alias("end_conv"),
        F.max(F.when(F.col("depth") > 0, F.get("bytes", F.col("depth") - 1)).otherwise(0)).alias("bytes"),
        F.max(F.slice("path", 1, F.col("depth") + 1)).alias("path"),
    )
    member = cut(member.withColumn("parent", F.get("path", (F.col("depth") - 1).cast("int"))))
    paths = F.arrays_zip(F.col("up1").alias("k1"), F.col("up2").alias("k2"))
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sums = (
        tops.select(F.explode(paths).alias("k"), none.alias("n_children"), "n_leaves", "saved_tokens")
        .union(tops.select(F.element_at(paths, -1).alias("k"), one, none, none))
        .union(member.filter("depth > 0").select("parent", one, none, none))
        .union(member.select(F.explode("path"), none, none, (F.col("n_convs") - 1) * F.col("bytes")))
        .groupBy("k")
        .agg(*[F.sum(n).alias(n) for n in ("n_children", "n_leaves", "saved_tokens")])
    )
    ids = member.select(F.col("k").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    uppers = member.join(cut(sums), "k").join(ids, "parent", "left")
    # a node without children is its own leaf
    uppers = uppers.withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("bigint"))
    named = tops.withColumn("parent", F.element_at(paths, -1)).drop("parent_conv_id").join(ids, "parent", "left")

    columns = [*COLUMNS[:-1], "ends", "end_conv", "k1", "k2"]
    every = cut(
        nodes.filter("up1 IS NULL").select(columns).union(named.select(columns)).union(uppers.withColumns({"k1": F.col("k.k1"), "k2": F.col("k.k2")}).select(columns))
    )
    ends = F.sha2(F.when(F.col("ends") == 1, F.col("end_conv").cast("string")).otherwise(""), 256).alias("ends_sha256")
    ending = ended.filter("below = 0").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"), "c")
    several = equal.filter("members > 1").select(F.col("e1").alias("k1"), F.col("e2").alias("k2"))
    hashes = digests(ending.join(several, ["k1", "k2"], "left_semi"))
    single = every.filter("ends < 2").select(*COLUMNS[:-1], ends)
    many = every.filter("ends > 1").join(hashes, ["k1", "k2"]).select(COLUMNS)

    chain = split.filter("d > u").join(convs, "c")
    end = F.when(F.col("d") == F.col("len"), F.col("c").cast("string")).otherwise("")
    child = F.when(F.col("d") == F.col("len"), none).otherwise(one)
    below = chain.select("c", "d", F.col("c").alias("p"), one.alias("n"), child.alias("k"), one.alias("l"), none.alias("s"), F.sha2(end, 256))
    return single.union(many).union(below.toDF(*COLUMNS))
