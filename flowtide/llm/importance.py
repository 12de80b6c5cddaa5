"""Quality by importance resampling (op6).

Words, runs of signs and pairs of neighbours are hashed into buckets. Two models give the share of each
bucket: one of target texts (labelled as good), one of all texts. A document's weight is the logarithm of
how much likelier the target model makes it; the k documents with the greatest weight plus Gumbel noise
are a sample without replacement in proportion to those weights.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import hash_sample, scan, spare, stored, texts

BUCKETS = 10_000
# Bound of the labelled sample that the target model is fitted on. The model of all texts has no bound.
MAX_TARGET = 50_000
SMOOTH = 1.0
SEED = 17
FEW, BINS = 10_000, 1_000

_PART = re.compile(rb"[a-z0-9_\x80-\xff]+|[^\sa-z0-9_\x80-\xff]+")


def buckets(text: str) -> np.ndarray:
    """The buckets of all words, runs of signs and pairs of neighbours of a text."""
    hashes = np.fromiter(map(zlib.crc32, _PART.findall(text.encode("utf-8").lower())), np.uint64)
    pairs = (hashes[:-1] * np.uint64(0x9E3779B1) + hashes[1:]) % np.uint64(4_294_967_291)
    return (np.concatenate([hashes, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def shares(rows: DataFrame) -> np.ndarray:
    """Smoothed log share of each bucket in texts (text)."""

    def build():
        counts = np.zeros(BUCKETS, np.int64)

        def step(batch):
            for t in texts(batch, 0):
                np.add.at(counts, buckets(t), 1)
            return ()

        def finish():
            found = np.flatnonzero(counts)
            yield {"b": found, "n": counts[found]}

        return step, finish

    total = np.full(BUCKETS, SMOOTH)
    for r in scan(rows, build, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        total[r.b] += r.n
    return np.log(total / total.sum())


def weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TARGET) -> tuple[DataFrame, float]:
    """docs with log_weight (null and empty texts: 0), and the share of good documents among the labelled.

    The target model is fitted on at most ``most`` documents labelled 1. Labels that contradict each other count as 0.
    Without any good document the target is all texts, and every weight 0.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(label).alias("good"))
    usable = stored(usable, "labels")
    n = usable.agg(F.count("*"), F.sum("good")).first()
    chosen = hash_sample(usable.where("good = 1").select("k"), "k", most, SEED)  # bounded, so it can be broadcast
    rows = docs.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("text"))
    raw = shares(rows.select("text"))
    target = shares(rows.join(F.broadcast(chosen), "k", "left_semi").select("text")) if n[1] else raw
    shared = docs.sparkSession.sparkContext.broadcast(target - raw)
    kept = [c for c in docs.columns if c != "log_weight"]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)

    def build():
        ratio = shared.value

        def step(batch):
            yield {c: batch.column(c) for c in kept} | {"log_weight": [float(ratio[buckets(t)].sum()) for t in texts(batch, text)]}

        return step

    return scan(docs.select(*kept), build, f"{fields}log_weight double"), (n[1] or 0) / n[0] if n[0] else 1.0


def top(rows: DataFrame, by: str, count: int, n: str) -> DataFrame:
    """rows (a stored table with a unique long column n) with boolean selected: the ``count`` rows of greatest ``by``, then least n.

    A histogram of the range that holds the last selected row is refined until few rows, or rows of one value,
    are left in it; nothing is sorted as a whole.
    """
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None or count <= 0:
        return rows.withColumn("selected", F.lit(False))
    above, within = 0, rows.count()  # rows over the range, rows inside
    if count >= within:
        return rows.withColumn("selected", F.lit(True))
    while within > FEW and high > low:
        width = (high - low) / BINS
        if low + width == low or high - width == high:
            break
        place = F.least(F.floor((F.col(by) - low) / width), F.lit(BINS - 1))
        inside = rows.where(F.col(by).between(low, high))
        bins = inside.groupBy(place.alias("b")).agg(F.count("*").alias("m"), F.min(by).alias("lo"), F.max(by).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r.b):  # BINS rows at most
            if above + r.m >= count:
                low, high, within = r.lo, r.hi, r.m
                break
            above += r.m
    edge = rows.where(F.col(by).between(low, high))
    if within > FEW:  # one value: the least n go first
        last = top(edge.select(n, (-F.col(n)).cast("double").alias("m")), "m", count - above, n).where("selected")
        final = F.col(n) <= last.agg(F.max(n)).first()[0]
        return rows.withColumn("selected", (F.col(by) > high) | ((F.col(by) == high) & final))
    last = edge.orderBy(F.desc(by), n).limit(count - above).agg(F.min(F.struct(F.col(by), -F.col(n)))).first()[0]
    return rows.withColumn("selected", F.struct(F.col(by), -F.col(n)) >= F.struct(F.lit(last[0]), F.lit(last[1]).cast("long")))


def resample(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    share: float | None = None, seed: int = SEED, most: int = MAX_TARGET,
) -> DataFrame:
    """All columns of docs with log_weight, gumbel_key and selected (true for the sampled rows); one row per row.

    ``share`` of all rows is sampled, by default as much as the labels call good. The noise is a function of
    the key, the text and the seed, so a run can be repeated; of equal rows those read first are taken. An empty table stays empty.
    """
    weighed, good = weights(docs, labels, key, text, label, most)
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)), F.lit(2**52)) + 0.5) / 2.0**52
    new = ("gumbel_key", "selected")
    n = spare(docs, "_n")
    rows = weighed.drop(*new).withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(unit)))
    rows = stored(rows.withColumn(n, F.monotonically_increasing_id()), "weighed")
    return top(rows, "gumbel_key", math.ceil((good if share is None else share) * rows.count()), n).drop(n)
