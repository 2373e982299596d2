"""Document quality from a text classifier and the sites documents come from.

A logistic model over dense and hashed word features gives each document its own evidence.
Sites form a hierarchy (host, then path): the share of good documents below a site is the
mean of its documents' probabilities, shrunk towards its parent's share by a beta prior whose
strength is fitted by moments over the sites of that level.  A document's posterior odds are
its evidence times the odds of its deepest site against the odds of the whole corpus.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from passbook.llm.common import slices
from passbook.storage import cut

#: At most so many labelled documents are trained on: those of the smallest hash of their key.
MAX_LABELLED = 4000
WORDS = 512
DENSE = 10
SLICE_BYTES = 2_000_000
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1e6

_SLOTS: dict[str, int] = {}


def features(text: str) -> np.ndarray:
    """Ten dense numbers of a text, then the shares of its words by hash."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    if len(_SLOTS) > 500_000:
        _SLOTS.clear()
    slots = []
    for w in words:
        slot = _SLOTS.get(w)
        if slot is None:
            slot = _SLOTS[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        slots.append(slot)
    lines = [line for line in text.split("\n") if line.strip()]
    marks = sum(map(text.count, "#*$%&|<>"))
    ends = sum(map(text.count, ".,!?"))
    upper = sum(map(str.isupper, words))
    dense = (
        1.0, math.log1p(len(words)) / 10, min(sum(map(len, words)) / n / 10, 2.0), min(10 * marks / chars, 2.0),
        1 - len(set(lines)) / max(len(lines), 1), len(set(words)) / n, min(ends / n, 2.0), upper / n,
        min(10 * sum(map(text.count, "0123456789")) / chars, 2.0), min(text.count("\n") / n, 1.0),
    )
    shares = np.bincount(np.array(slots, dtype=np.int64), minlength=WORDS) / n
    return np.concatenate([dense, np.sqrt(shares)])


def mapped(docs: DataFrame, text: str, schema: str, of) -> DataFrame:
    """``docs`` without ``text`` and with the columns of ``schema`` that ``of(text)`` gives."""
    others = [c for c in docs.columns if c != text]
    full = StructType([*docs.select(others).schema.fields, *StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            rows = [of(t or "") for t in batch.column(text).to_pylist()]
            more = [pa.array(c, arrow.field(len(others) + i).type) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in others), *more], schema=arrow)

    return docs.select(*others, text).mapInArrow(run, full)


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> np.ndarray:
    """Weights from a bounded sample of ``labelled`` (key, text, label 0 or 1).

    Rows without a label are left out.  Without both labels in the sample every weight is 0.
    """
    rows = mapped(
        labelled.select(F.col(label).cast("double").alias("y"), text), text, "x binary", lambda t: (features(t).astype("<f4").tobytes(),)
    ).collect()
    weights = np.zeros(DENSE + WORDS)
    if len({r["y"] for r in rows}) < 2:
        return weights
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], dtype=float)
    y = np.array([r["y"] for r in rows])
    step = 4 / (np.linalg.norm(x, 2) ** 2 / len(x))
    before = weights
    for i in range(1, 401):  # accelerated gradients with a light ridge
        ahead = weights + (i - 1) / (i + 2) * (weights - before)
        p = 1 / (1 + np.exp(-(x @ ahead)))
        before, weights = weights, ahead - step * (x.T @ (p - y) / len(x) + 1e-4 * ahead)
    return weights


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int) -> DataFrame:
    """(key, text, label) of the ``most`` labelled documents whose key's hash is smallest.

    Of several labels of one key the smallest counts; null labels and keys are left out.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias(label))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most)
    return docs.select(key, text).join(F.broadcast(chosen), key)  # bounded by `most`


def strength(groups: DataFrame, child: list[str], parent: list[str]) -> float:
    """Documents a beta prior around the parent's share is worth, by moments (one row)."""
    by_child = groups.groupBy(child).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    if parent:
        above = groups.groupBy([F.col(p).alias(f"__{p}") for p in parent]).agg(F.sum("n").alias("pn"), F.sum("good").alias("pgood"))
        on = [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in parent]
    else:
        above = groups.groupBy(F.lit(1).alias("__one")).agg(F.sum("n").alias("pn"), F.sum("good").alias("pgood"))
        by_child = by_child.withColumn("__of", F.lit(1))
        on = [F.col("__of") == F.col("__one")]
    m = F.col("pgood") / F.col("pn")
    d = F.col("good") - F.col("n") * m
    noise = m * (1 - m)
    row = by_child.join(above, on).agg(
        F.sum(d * d - F.col("n") * noise).alias("excess"), F.sum(F.col("n") * (F.col("n") - 1) * noise).alias("possible")
    ).first()
    if not row["possible"] or row["excess"] <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, row["possible"] / row["excess"] - 1))


def logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, weights: np.ndarray, levels: list[str], key: str = "doc_id", text: str = "text", threshold: float = 0.5
) -> DataFrame:
    """(key, levels, evidence, site_share, quality, kept) of every document.

    ``levels``: site columns from the widest (host) to the narrowest (path); null is a site of
    its own at each level.  A null or empty text is judged by its site and the classifier's
    intercept.  Equal rows are judged one by one; other columns are left out.
    """
    w = np.asarray(weights, dtype=float)

    def evidence(value: str) -> tuple[float]:
        return (float(1 / (1 + np.exp(-np.clip(features(value) @ w, -30, 30)))),)

    scored = cut(mapped(docs.select(key, *levels, text), text, "evidence double", evidence))
    groups = cut(scored.groupBy(levels).agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("good")))
    total = groups.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    prior = total["good"] / total["n"] if total["n"] else 0.5

    shares, parent = None, F.lit(prior)
    for depth in range(1, len(levels) + 1):
        own = levels[:depth]
        k = strength(groups, own, own[:-1])
        level = groups.groupBy(own).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        if shares is not None:
            above = shares.select(*[F.col(c).alias(f"__{c}") for c in own[:-1]], "share")
            level = level.join(above, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in own[:-1]]).drop(*[f"__{c}" for c in own[:-1]])
            parent = F.col("share")
        shares = level.select(*own, ((F.col("good") + k * parent) / (F.col("n") + k)).alias("share"))
    sites = cut(shares.select(*[F.col(c).alias(f"__{c}") for c in levels], F.col("share").alias("site_share")))
    joined = scored.join(sites, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels])
    odds = logit(F.col("evidence")) + logit(F.col("site_share")) - logit(F.lit(prior))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select(key, *levels, "evidence", "site_share", quality.alias("quality"), (quality >= threshold).alias("kept"))
