"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded (hashed byte bigrams and shape counts, then a dense layer),
a gated attention network weighs the passages, and the weighted representation is scored. Encoder, attention and score
are learnt together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandspark.llm.common import byte_blocks, give_back

#: Bytes of a passage, hash buckets of byte bigrams, and sizes of the passage code and of the attention.
PASSAGE, BUCKETS, CODE, GATE = 512, 256, 24, 12
#: Labelled documents that the model is fitted on at most (those with the smallest seeded hashes).
FIT_ROWS = 3000
#: Passages of one of them at most; scoring looks at all.
FIT_PASSAGES = 512
_KIND = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b".,;:'\"-()", b"!?", b"#*$%&|<>", b"{}[]=+/\\_^~`@")):
    _KIND[list(_chars)] = _k + 1
_KIND[128:] = 9
#: Shape: ten byte kinds, five lags of self-overlap, and the share of bigram buckets in use.
WIDTH = BUCKETS + 10 + 5 + 1


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a byte block, and the number of passages of each text (at least one)."""
    sizes = np.diff(offsets)
    many = np.maximum(-(-sizes // PASSAGE), 1)
    x = np.zeros((int(many.sum()), WIDTH), np.float32)
    if len(data):
        text = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(many) - many
        mine = first[text] + (np.arange(len(data)) - offsets[text]) // PASSAGE
        n = np.bincount(mine, minlength=len(x)).astype(np.float32)
        pair = (data[:-1].astype(np.int64) * 31 + data[1:].astype(np.int64) * 17) % BUCKETS
        inside = mine[1:] == mine[:-1]
        x[:, :BUCKETS] = np.bincount(mine[:-1][inside] * BUCKETS + pair[inside], minlength=len(x) * BUCKETS).reshape(len(x), BUCKETS)
        used = (x[:, :BUCKETS] > 0).sum(axis=1)
        x[:, BUCKETS : BUCKETS + 10] = np.bincount(mine * 10 + _KIND[data], minlength=len(x) * 10).reshape(len(x), 10)
        for k, lag in enumerate((3, 4, 5, 8, 12)):
            same = (data[lag:] == data[:-lag]) & (mine[lag:] == mine[:-lag])
            x[:, BUCKETS + 10 + k] = np.bincount(mine[lag:][same], minlength=len(x))
        n = np.maximum(n, 1)[:, None]
        x[:, : WIDTH - 1] /= n
        x[:, :BUCKETS] = np.sqrt(x[:, :BUCKETS]) * 2
        x[:, BUCKETS : WIDTH - 1] *= 4
        x[:, WIDTH - 1] = used / np.minimum(n[:, 0], 160)
    return x, many


def forward(model: dict, x: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, dict]:
    """Scores of bags: passages `x`, `many` of them in each bag."""
    start = np.cumsum(many) - many
    h = np.tanh((x - model["mean"]) @ model["W"] + model["b"])
    v, u = np.tanh(h @ model["V"]), 1 / (1 + np.exp(-(h @ model["U"])))
    e = (v * u) @ model["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), many))
    a = e / np.repeat(np.add.reduceat(e, start), many)
    z = np.add.reduceat(a[:, None] * h, start, axis=0)
    score = 1 / (1 + np.exp(-(z @ model["c"] + model["d"])))
    return score, {"h": h, "v": v, "u": u, "a": a, "z": z, "start": start}


def fit(x: np.ndarray, many: np.ndarray, label: np.ndarray, seed: int = 42, rounds: int = 40, rate: float = 0.01, batch: int = 128) -> dict:
    """Fit by Adam on the log loss, both labels weighing the same in sum up to a factor of three."""
    rng = np.random.default_rng(seed)
    model = {"mean": x.mean(axis=0) if len(x) else np.zeros(WIDTH), "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, CODE)), "b": np.zeros(CODE), "V": rng.normal(0, 0.3, (CODE, GATE)), "U": rng.normal(0, 0.3, (CODE, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, CODE), "d": np.zeros(1)}
    model = {k: p.astype(np.float64) for k, p in model.items()}
    if not len(label) or label.min() == label.max():
        model["c"][:], model["d"][:] = 0, 4 if not len(label) or label.min() else -4
        return model
    rate_of = label.mean()
    weight = np.where(label > 0, 1.0, min(rate_of / (1 - rate_of), 3.0))
    names = [k for k in model if k != "mean"]
    m, s, t = {k: np.zeros_like(model[k]) for k in names}, {k: np.zeros_like(model[k]) for k in names}, 0
    first = np.cumsum(many) - many
    for _ in range(rounds):
        for docs in np.array_split(rng.permutation(len(label)), max(len(label) // batch, 1)):
            n = many[docs]
            rows = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            xb = x[rows].astype(np.float64)
            p, f = forward(model, xb, n)
            g = (p - label[docs]) * weight[docs] / len(docs)
            grad = {"c": f["z"].T @ g, "d": np.array([g.sum()])}
            dz = np.repeat(g[:, None] * model["c"][None, :], n, axis=0)
            da = (dz * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["start"]), n))
            grad["w"] = (f["v"] * f["u"]).T @ de
            dv, du = de[:, None] * model["w"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * model["w"] * f["v"] * f["u"] * (1 - f["u"])
            grad["V"], grad["U"] = f["h"].T @ dv, f["h"].T @ du
            dh = (f["a"][:, None] * dz + dv @ model["V"].T + du @ model["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = (xb - model["mean"]).T @ dh, dh.sum(axis=0)
            t += 1
            for k in names:
                gk = grad[k] + 1e-4 * model[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                s[k] = 0.999 * s[k] + 0.001 * gk**2
                model[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def _thinned(bag: np.ndarray) -> np.ndarray:
    """At most FIT_PASSAGES passages of a document that is fitted on, evenly spread."""
    return bag if len(bag) <= FIT_PASSAGES else bag[np.linspace(0, len(bag) - 1, FIT_PASSAGES).astype(np.int64)]


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in byte_blocks(batches, 512 << 10):
        x, many = passages(data, offsets)
        ends = np.cumsum(many)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array([_thinned(x[e - n : e]).astype(np.float16).tobytes() for e, n in zip(ends.tolist(), many.tolist(), strict=True)], pa.binary())],
            ["doc_id", "quality", "bag"],
        )
    give_back()


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, seed: int = 42) -> dict:
    """Fit on a bounded sample of labelled documents, never on those whose crc32(doc_id) is divisible by 5.

    The sample's passages are encoded on the executors; at most `rows` bags of FIT_PASSAGES passages reach the driver.
    Rows without doc_id or label are not fitted on; of a doc_id's several labels the greatest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "doc_id").mapInArrow(_bags, "doc_id long, quality int, bag binary").toArrow()
    rows = sorted(zip(*(found.column(c).to_pylist() for c in ("doc_id", "quality", "bag")), strict=True))
    x = [np.frombuffer(bag, np.float16).reshape(-1, WIDTH) for _, _, bag in rows]
    many, label = np.array([len(b) for b in x], np.int64), np.array([q for _, q, _ in rows], np.float64)
    model = fit(np.concatenate(x).astype(np.float32) if x else np.zeros((0, WIDTH), np.float32), many, label, seed)
    del found, rows, x
    give_back()
    return model


def _score_batches(batches: Iterable[pa.RecordBatch], model: dict) -> Iterator[pa.RecordBatch]:
    model = {k: p.astype(np.float32) for k, p in model.items()}
    for batch, data, offsets in byte_blocks(batches, 512 << 10):
        score, _ = forward(model, *passages(data, offsets))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64))], [*batch.schema.names, "score"])
    give_back()


def score_documents(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """All columns of `docs` with score (0 to 1) and predicted (1 from `threshold` on), one row per input row.

    Only the text is looked at; every passage of it counts. Null and empty texts are one empty passage and are scored;
    repeated rows stay; an empty table gives no rows. Columns named score or predicted are replaced.
    """
    source = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(partial(_score_batches, model=model), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
