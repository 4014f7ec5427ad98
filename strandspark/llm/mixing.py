"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.llm.common import save, words_count

#: Sums that the dynamic programme looks at in all, over all lengths, and at once.
DP_CELLS, DP_SUMS = 1 << 28, 1 << 22
#: Documents of one length that a hash slice should hold; larger groups are cut into more slices.
SLICE = 4096
#: Sources whose targets are broadcast; those of more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 42) -> np.ndarray:
    """How many of each length to take so that their sum comes as near to `budget` as can be without passing it.

    A bounded-knapsack dynamic programme over exact sums fits the budget, or the last `room` words of a larger one: `room`
    is twice the longest length at least, so that any document can be in it. What is above is taken in proportion to the
    counts, rounded up or down at random by `seed`. For each sum the programme holds the first length that reaches it
    and how often; it stops when the whole budget is met.
    """
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((lengths > 0) & (counts > 0))
    total = int((lengths * counts)[usable].sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        take[usable] = counts[usable]
        return take
    rng = np.random.default_rng(seed)
    room = min(budget, max(2 * int(lengths[usable].max()), min(DP_SUMS, DP_CELLS // len(usable))))
    if budget > room:
        share = (budget - room // 2) / total
        take[usable] = np.minimum(np.floor(counts[usable] * share + rng.random(len(usable))), counts[usable]).astype(np.int64)
        rest = budget - int((take * lengths).sum())
        while not 0 <= rest <= room:  # one document more or less of lengths in random order
            step = 1 if rest > room else -1
            for i in rng.permutation(usable):
                if 0 <= rest <= room:
                    break
                if 0 <= take[i] + step <= counts[i]:
                    take[i] += step
                    rest -= step * int(lengths[i])
        room = rest
    items = [i for i in rng.permutation(usable) if counts[i] > take[i] and lengths[i] <= room]
    item, often = np.full(room + 1, -1, np.int32), np.zeros(room + 1, np.int32)
    item[0] = len(items)
    for k, i in enumerate(items):
        n, left = int(lengths[i]), int(counts[i] - take[i])
        # sums by their rest on division by n: a sum is reached if one at most `left` steps of n below it was
        rows = -(-(room + 1) // n)
        known = np.zeros(rows * n, bool)
        known[: room + 1] = item >= 0
        step = np.arange(rows, dtype=np.int32)[:, None]
        last = np.maximum.accumulate(np.where(known.reshape(rows, n), step, -(left + 1)), axis=0)
        steps = (step - last).ravel()[: room + 1]
        new = (steps > 0) & (steps <= left)
        item[new], often[new] = k, steps[new]
        if item[room] >= 0:
            break
    at = int(np.flatnonzero(item >= 0)[-1])
    while at:
        i = items[item[at]]
        take[i] += often[at]
        at -= int(often[at]) * int(lengths[i])
    return take


def share_targets(sizes: dict, weights: list[float], max_repeat: float) -> dict:
    """Targets by weight of the sum of all sizes; none above `max_repeat` times its size, the excess reshared by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode("utf-32-be") if s is not None else b""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, target = float(sum(sizes.values())), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if budget * weight[s] / whole > max_repeat * sizes[s]]
        if not full:
            return target | {s: budget * weight[s] / whole for s in open_}
        for s in full:
            target[s] = max_repeat * sizes[s]
        budget -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in target]
    return target


def _plan(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")  # so that reruns agree
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    source_size, target = int((lengths * counts).sum()), float(group["target"].iloc[0])
    passes = int(target // source_size) if source_size else 0
    take = knapsack(lengths, counts, round(target) - passes * source_size)
    return pd.DataFrame({"source_key": key[0], "size": lengths, "n": counts, "passes": passes, "extra": take})


def mix(docs: DataFrame, weights: list[float], max_repeat: int = 3, seed: int = 42) -> DataFrame:
    """Choose how often each document is repeated so that every source's words come near its target.

    Size is the number of ASCII-space separated words (null text: 0). Sources in code point order, null last, take the
    weights in turn and share the sum of all sizes; see :func:`share_targets`. Each source takes whole passes of all
    its documents and fits the rest by :func:`knapsack` over its histogram of exact lengths; of the documents of one
    length those with the smallest seeded hashes of id and text are taken. Equal rows are interchangeable, so reruns agree.

    Returns one row per input row: doc_id, source, size, source_size, target, copies, taken (copies times size). A
    document without words is never taken; rows that repeat a doc_id, or have none, are documents of their own; an empty
    table gives no rows; extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    rank = F.xxhash64(F.lit(seed), "doc_id", "mark")
    rows = save(rows.withColumn("source_key", F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))).withColumn("rank", rank), "mix")
    lengths = rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    found = {r["source_key"]: r["source_size"] for r in sources.collect()}  # one row a source
    by_name = {k[1:] if k[0] == "+" else None: v for k, v in found.items()}
    targets = share_targets(by_name, weights, max_repeat)
    spark = docs.sparkSession
    schema = "source_key string, source_size long, target double"
    known = spark.createDataFrame([(k, int(v), float(targets[k[1:] if k[0] == "+" else None])) for k, v in found.items()], schema)
    known = F.broadcast(known) if len(found) <= BROADCAST_SOURCES else known
    plan = lengths.join(known, "source_key").groupBy("source_key").applyInPandas(_plan, "source_key string, size long, n long, passes long, extra long")
    plan = save(plan, "mix-plan")
    # the `extra` smallest hashes of each length: whole hash slices below, row numbers only in the slice on the edge
    slices = F.greatest(F.ceil(F.col("n") / SLICE), F.lit(1)).cast("long")
    cut = rows.join(plan.withColumn("slices", slices), ["source_key", "size"])
    cut = cut.withColumn("slice", F.floor((F.shiftrightunsigned("rank", 33).cast("double") / float(1 << 31)) * F.col("slices")).cast("long"))
    edge = cut.where("extra > 0 and extra < n")
    part = edge.groupBy("source_key", "size", "slice").agg(F.count(F.lit(1)).alias("m"))
    below = W.partitionBy("source_key", "size").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("before", F.coalesce(F.sum("m").over(below), F.lit(0)))
    cut = cut.join(part, ["source_key", "size", "slice"], "left")
    left = F.col("extra") - F.col("before")
    state = F.when((F.col("extra") <= 0) | (left <= 0), 0).when((F.col("extra") >= F.col("n")) | (left >= F.col("m")), 1).otherwise(2)
    cut = cut.withColumn("state", state).withColumn("left", left)
    out = ["doc_id", "source", "size", "source_key", "passes"]
    sure = cut.where("state < 2").select(*out, F.col("state").cast("long").alias("one"))
    order = W.partitionBy("source_key", "size", "slice").orderBy("rank", "doc_id")
    edge = cut.where("state = 2").withColumn("k", F.row_number().over(order)).select(*out, (F.col("k") <= F.col("left")).cast("long").alias("one"))
    chosen = sure.unionByName(edge).join(known, "source_key")
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("one")).otherwise(0).cast("long")
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
