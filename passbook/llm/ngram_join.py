"""A similarity self-join of shingle sets by rare-first prefix filtering.

Sets of n shingles that are similar enough miss at most e(n) of each other's shingles.  Every set
keeps the 2 e(n) + 1 shingles that come first in hash order; similar sets share e + 1 of these
(e of the smaller possible partner).  Shingles that only one set has are counted per set, and
sets without enough others are done.  The others order what they kept by rarity; of similar
sets each has one of the other's among its first |kept| - e: the prefix.  Sets meet in the
posting lists of their prefix shingles.

A pair of a posting list passes by size, by position (the places behind the shared shingle must
leave room for the rest of the overlap) and by the suffix filter: the token space is split into
BINS ranges, and the sum of the differences of counts per range is a lower bound of the symmetric
difference.  Pairs that pass are verified once on the full sets.

Only components are asked for, so pairs of nodes that are linked already are left out.  In each
round a set offers its nearest partners of other components, by the bound of the suffix filter;
the number offered grows until no set has more, and a set leaves the lists where it has none.  Posting lists are compared chunk by chunk, in
bounded memory; what a round makes grows with the postings, not with their pairs.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.llm.common import sized
from passbook.llm.graph import components
from passbook.llm.sets import across, confirmed, digest, document_components, hashes_of, mapped, nodes_of, shingles
from passbook.storage import cut

SHINGLE, PERCENT = 3, 90
#: Ranges of the suffix filter; nodes of a chunk of a posting list.
BINS, CHUNK = 64, 1024
#: Partners a node offers per posting list in the first round, and by how much more in each further one.
OFFERED, GROWTH = 1, 8
#: Rows of whole groups that a task compares at a time.
HELD = 4096


def missing(n: Column | int, percent: int):
    """Shingles a set of n may have that a set similar enough has not."""
    if isinstance(n, int):
        return n - (percent * n + 99) // 100
    return n - F.floor((percent * n + 99) / 100)


def shared(n: Column, percent: int) -> Column:
    """Kept shingles that similar sets share at least, by the size of either."""
    return missing(n - missing(n, percent), percent) + 1


def kept(hashes: np.ndarray, percent: int) -> np.ndarray:
    return hashes[: 2 * missing(len(hashes), percent) + 1].astype(np.int64)


def overlap(total, percent: int):
    """Shingles that similar sets of ``total`` shingles together have in common at least."""
    return -(-percent * total // (100 + percent))


def rarest(heads: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(h, node, n, m, pos, need): the prefix postings of ``heads`` (node, n, head) that another set may share.

    ``m`` is the number of shingles kept, ``need`` how many of them a similar set shares at least,
    ``pos`` the place in rare-first order.
    """
    least = (F.col("n") - missing(F.col("n"), percent) if whole else shared(F.col("n"), percent)).cast("bigint")
    heads = heads.withColumns({"m": F.size("head").cast("bigint"), "need": least})
    counts = heads.select("node", F.explode("head").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node"))
    several = F.col("df") > 1
    # a shingle of one set alone names its set, any other itself
    counts = cut(counts.select(F.when(several, F.col("h")).alias("h"), F.when(several, F.col("df")).alias("df"), F.when(~several, F.col("node")).alias("node")))
    alone = counts.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    sized = heads.select("node", "n", "m", "need").join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    open_ = cut(sized.filter("m - alone >= need"))
    tokens = heads.select("node", "head").join(open_, "node").select("node", "n", "m", "need", "alone", F.explode("head").alias("h"))
    common = tokens.join(counts.filter("h IS NOT NULL").select("h", "df"), "h")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("df", "h"))
    placed = common.withColumn("pos", (F.col("alone") + rank).cast("bigint"))
    return cut(placed.filter("pos <= m - need + 1").select("h", "node", "n", "m", "pos", "need"))


def sketched(sets: DataFrame) -> DataFrame:
    """(node, sketch): shingles per range of the token space, 255 at most, which keeps the bound a lower one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("hashes")
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            at = row * BINS + (values >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
            counts = np.minimum(np.bincount(at, minlength=len(lists) * BINS), 255).astype(np.uint8).reshape(-1, BINS)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([c.tobytes() for c in counts], pa.binary())], ["node", "sketch"])

    return sets.select("node", "hashes").mapInArrow(run, "node bigint, sketch binary")


def offers(members: DataFrame, most: int, percent: int, whole: bool) -> DataFrame:
    """(a, b) of the pairs that pass all filters, ``most`` nearest ones per node and list; (open, a) of lists and their nodes with further ones.

    ``members``: (h, i, j, own, node, label, n, m, pos, need, sketch); chunks i and j of the list h meet.
    """

    def compare(rows: pa.Table) -> pa.RecordBatch:
        col = {n: rows.column(n).to_numpy() for n in ("h", "i", "j", "own", "node", "label", "n", "m", "pos", "need")}
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (col["h"][1:] != col["h"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])
        group, room = np.cumsum(new), col["m"] - col["pos"] + 1
        xs, ys, ds = [], [], []
        for apart in range(1, len(rows)):
            x = np.nonzero(group[apart:] == group[:-apart])[0]
            if not len(x):
                break
            y = x + apart
            n1, n2 = col["n"][x], col["n"][y]
            fits = (col["label"][x] != col["label"][y]) & (100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2))
            least = overlap(n1 + n2, percent) if whole else np.maximum(col["need"][x], col["need"][y])
            fits &= np.minimum(room[x], room[y]) >= least
            # chunks of one list meet once; inside a chunk only where it meets itself
            fits &= (col["i"][x] == col["j"][x]) | (col["own"][x] != col["own"][y])
            x, y, total = x[fits], y[fits], (n1 + n2)[fits]
            apart_by = np.abs(sketch[x] - sketch[y]).sum(axis=1, dtype=np.int64)
            near = apart_by <= total - 2 * overlap(total, percent)
            xs.append(x[near])
            ys.append(y[near])
            ds.append(apart_by[near])
        x, y, d = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, ds))
        one, other, d = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([d, d])
        order = np.lexsort((col["node"][other], d, one))
        one, other = one[order], other[order]
        first = np.searchsorted(one, one, side="left")
        chosen = np.arange(len(one)) - first < most
        more = np.unique(np.stack([col["h"][one[~chosen]], col["node"][one[~chosen]]]), axis=1)
        a, b = col["node"][one[chosen]], col["node"][other[chosen]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        pair = np.arange(pairs.shape[1] + more.shape[1]) < pairs.shape[1]
        a, b, h = np.append(pairs[0], more[1]), np.append(pairs[1], more[1]), np.append(pairs[0], more[0])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=~pair), pa.array(h, mask=pair)], ["a", "b", "open"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            rest = held
            if len(held) < HELD:
                continue
            last = [held.column(n)[-1].as_py() for n in ("h", "i", "j")]
            same = np.ones(len(held), dtype=bool)
            for n, v in zip(("h", "i", "j"), last, strict=True):
                same &= held.column(n).to_numpy() == v
            whole = len(held) - int(same.sum())  # the last group may go on
            rest = held.slice(whole)
            if whole:
                yield compare(held.slice(0, whole).combine_chunks())
        if rest is not None and len(rest):
            yield compare(rest.combine_chunks())

    dealt = members.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint, open bigint")


def merged(postings: DataFrame) -> DataFrame:
    """``postings`` with lists of the same nodes made one, where each node has its first place.

    Copies of a text share most of their prefix, and would meet in a list for every shingle of it.
    Lists are told apart by a hash of their nodes: were two hashes equal, the lists' nodes would
    meet one another too, and no pair would be lost.
    """
    lists = postings.groupBy("h").agg((F.min("node") < F.max("node")).alias("open"), F.bit_xor(F.xxhash64("node")).alias("nodes"))
    named = postings.join(cut(lists.filter("open").select("h", "nodes")), "h")
    return cut(named.groupBy(F.col("nodes").alias("h"), "node", "n", "m", "need").agg(F.min("pos").alias("pos")))


def similar_links(
    heads: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    percent: int,
    links: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """(a, b): links that join all components of similar sets; known ``links`` are among them.

    ``heads``: (node, n, head), one per distinct set, ``head`` as ``kept`` gives it, or with
    ``whole`` the whole set; ``sets_of(ids)``: (node, hashes) of the ids (node).
    """
    postings = merged(rarest(heads, percent, whole))
    sets = cut(sets_of(postings.select("node").distinct()))
    postings = cut(postings.join(sketched(sets).dropDuplicates(["node"]), "node"))
    found, tried, most = links, None, OFFERED
    known, places = sets.count(), postings.count()
    labels = None if links is None else components(links)
    while True:
        named = postings.withColumn("label", F.col("node"))
        if labels is not None:
            joined = postings.join(labels.select(F.col("a").alias("node"), F.col("b").alias("label")), "node", "left")
            named = joined.withColumn("label", F.coalesce("label", "node"))
        sizes = named.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"))
        chunks = F.expr(f"cast(ceil(size / {CHUNK}) AS bigint)").alias("chunks")
        lists = cut(sized(sizes.filter("lo < hi").select("h", chunks, "size"), places))
        dealt = lists.agg(F.coalesce(F.sum(F.col("size") * F.col("chunks")), F.lit(0))).first()[0]
        members = named.join(lists.drop("size"), "h")
        members = members.withColumn("own", F.expr("pmod(xxhash64(node), chunks)"))
        members = members.withColumn("with", F.explode(F.expr("sequence(0L, chunks - 1)")))
        members = members.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")})
        columns = ["h", "i", "j", "own", "node", "label", "n", "m", "pos", "need", "sketch"]
        met = cut(sized(sized(offers(members.select(columns), most, percent, whole), dealt).distinct(), dealt))
        pairs = met.filter("open IS NULL").select("a", "b")
        more = met.filter("open IS NOT NULL").select(F.col("open").alias("h"), F.col("a").alias("node"))
        if tried is not None:
            pairs = cut(sized(pairs.join(tried, ["a", "b"], "left_anti"), dealt + tried.count()))
        new = confirmed(pairs, sets, percent, pairs.count() + known)
        if not new.isEmpty():
            found = new if found is None else cut(found.union(new))
            labels = components(found)
        if more.isEmpty():
            return new if found is None else found
        # a pair is left over only if it is for both its nodes: all others were offered, or are linked
        postings = cut(sized(postings.join(more, ["h", "node"], "left_semi"), places))
        places = postings.count()
        tried = pairs if tried is None else cut(tried.union(pairs))
        most *= GROWTH


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Rows that share a key are one document with several texts.  A text without words has no
    shingles and links with nothing.  A null key is its own component, null.  Other columns are
    left out.  Shingles are compared by 64-bit, sets by 128-bit hashes.
    """

    def of(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, size) for t in texts]
        names = [digest(s) for s in sets]
        heads = [kept(s, percent) if len(s) else [] for s in sets]
        return [[len(s) for s in sets], [n[0] for n in names], [n[1] for n in names], heads]

    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = mapped(own, "key", "text", "n bigint, s1 bigint, s2 bigint, head array<bigint>", of)
    rows = cut(found.withColumn("row", F.monotonically_increasing_id()))
    nodes = nodes_of(rows)
    heads = rows.select(F.col("row").alias("node"), "n", "head").join(nodes.select("node"), "node", "left_semi")
    links = similar_links(heads, lambda ids: hashes_of(own, nodes, ids, size), percent)
    done = document_components(rows, nodes, links)
    return done.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
