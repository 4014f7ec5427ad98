"""SimHash near-duplicate detection with bit-sliced distance counting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import IS_SPACE, byte_blocks, give_back, save, shuffle_partitions, union_labels
from strandspark.llm.components import connected_components

#: Members of one bucket that a task compares at once; larger buckets are cut into tiles of this size.
TILE = 16384
#: Lanes (query, 64-member word) that the kernel holds at once.
LANES = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 values of the word shingles of each text in a byte block, with repeats, and the text each is of."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    start = ~space & (before | first)
    keep = ~space | ~(before | first)  # a word's bytes and the one space after it
    clean = np.where(space, np.uint8(32), _LOWER[data])[keep]
    to = np.cumsum(keep) - 1
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = space[1:] | first[1:]
    ends = to[np.flatnonzero(~space & last)] + 1
    starts = to[starts]
    per = np.bincount(doc, minlength=n)
    head = np.cumsum(per) - per
    # a shingle starts at word i of its document if i + width words are there, or is the whole short document
    rank = np.arange(len(doc)) - head[doc]
    whole = per[doc] < width
    first_of = np.flatnonzero(np.where(whole, rank == 0, rank <= per[doc] - width))
    last_of = np.where(whole[first_of], head[doc[first_of]] + per[doc[first_of]] - 1, first_of + width - 1)
    raw, h = clean.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(raw[a:b], seed) for a, b in zip(starts[first_of].tolist(), ends[last_of].tolist(), strict=True)), np.uint64, len(first_of))
    return hashes, doc[first_of]


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text in a byte block: majority of the bits of its word shingles' XXH64 values."""
    return majority(*shingle_hashes(data, offsets, width, seed), len(offsets) - 1)


def majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The bits that are set in over half of the hashes of each of n texts."""
    if not len(hashes):
        return np.zeros(n, np.uint64)
    step = 1 << 18
    ones = np.zeros((n, 64), np.int64)
    for at in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        who = owner[at : at + step]
        cut = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        ones[who[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(batches: Iterable[pa.RecordBatch], width: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in byte_blocks(batches, 1 << 20):
        fp = fingerprints(data, offsets, width, seed).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp)], ["doc_id", "fp"])
    give_back()


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Vertical form: row b holds bit b of 64 values in each word; the last word is padded with zeros."""
    wide = np.zeros(-(-max(len(values), 1) // 64) * 64, np.uint64)
    wide[: len(values)] = values
    bits = np.unpackbits(wide.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(planes: np.ndarray, queries: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (query[i], word[i]) with some member within `radius` bits, and the mask of such members.

    Differing bits are counted in carry-save counters, three planes to an adder; a lane whose 64 members have all
    gone past the radius is abandoned. `radius` is one less than a power of two.
    """
    counters = (radius + 1).bit_length() - 1
    lane = np.arange(len(query))
    count = [np.zeros(len(query), np.uint64) for _ in range(counters)]
    over = np.zeros(len(query), np.uint64)
    q, w = query, word

    def diff(b: int) -> np.ndarray:
        return planes[b][w] ^ (np.uint64(0) - ((queries[q] >> np.uint64(b)) & np.uint64(1)))

    for b in range(0, 64, 3):
        x = diff(b)
        if b + 2 < 64:
            y, z = diff(b + 1), diff(b + 2)
            s = x ^ y
            carries, s = [(x & y) | (s & z)], s ^ z
        else:
            carries, s = [], x
        ins = [s]  # bits of this weight to add
        for k in range(counters):
            up = carries
            for bit in ins:
                up = [*up, count[k] & bit]
                count[k] = count[k] ^ bit
            ins, carries = up, []
        for bit in ins:
            over = over | bit
        if b % 12 == 9:
            live = over != _FULL
            if not live.all():
                lane, q, w, over = lane[live], q[live], w[live], over[live]
                count = [c[live] for c in count]
                if not len(lane):
                    break
    hit = over != _FULL
    return lane[hit], ~over[hit]


def _bucket_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) between fingerprints of one bucket within `radius`; rows are sorted by key."""
    n = len(key)
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    hi = np.repeat(np.r_[cut[1:], n], np.diff(np.r_[cut, n]))
    row = np.arange(n)
    w0, w1 = (row + 1) // 64, np.maximum(hi - 1, 0) // 64
    lanes = np.where(row + 1 < hi, w1 - w0 + 1, 0)
    planes, parent = bit_planes(fp), np.arange(n)
    ends = np.cumsum(lanes)
    at = 0
    while at < n:
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, "right")), at + 1)
        many = lanes[at:to]
        q = np.repeat(row[at:to], many)
        w = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + w0[q]
        if len(q):
            got, mask = within_radius(planes, fp, q, w, radius)
            member = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, bit = np.nonzero(member)
            a, b = q[got[i]], w[got[i]] * 64 + bit
            ok = (b > a) & (b < hi[a])
            ok[ok] &= (side[a[ok]] != side[b[ok]]) | (side[a[ok]] == 0)
            union_labels(parent, a[ok], b[ok])
        at = to
    linked = np.flatnonzero(parent != row)
    return fp[parent[linked]], fp[linked]


def _link_batches(batches: Iterable[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, tile); whole buckets are handled together, the last one waits for the next batch."""

    def links(t: pa.Table) -> pa.RecordBatch:
        k1 = t.column("key").to_numpy().astype(np.int64)
        k2 = t.column("tile").to_numpy().astype(np.int64)
        key = np.cumsum(np.r_[0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        a, b = _bucket_links(key, t.column("fp").to_numpy().astype(np.int64).view(np.uint64), t.column("side").to_numpy().astype(np.int64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2 = batch.column("key").to_numpy(zero_copy_only=False), batch.column("tile").to_numpy(zero_copy_only=False)
        same = (k1 == k1[-1]) & (k2 == k2[-1])
        cut = int(batch.num_rows - (len(same) if same.all() else np.argmin(same[::-1])))
        if cut == 0 and held and held[-1].column("key")[-1].as_py() == k1[0] and held[-1].column("tile")[-1].as_py() == k2[0]:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        done = pa.Table.from_batches(held)
        if done.num_rows:
            yield links(done)
        held = [batch.slice(cut)]
    if held:
        yield links(pa.Table.from_batches(held))


def pigeonhole_masks(n: int, radius: int) -> list[int]:
    """Bit masks of the key parts: 64 bits in g pieces, any g - radius of which must agree for some choice.

    g grows with the number of fingerprints so that a bucket of unrelated ones stays small; every choice of g finds
    exactly the same pairs.
    """
    g = radius + 1
    while g < 2 * radius and n / 2 ** (64 * (g - radius) // g) > 64:
        g += 1
    edge = [64 * i // g for i in range(g + 1)]
    piece = [((1 << (edge[i + 1] - edge[i])) - 1) << edge[i] for i in range(g)]
    return [sum(piece[i] for i in pick) for pick in combinations(range(g), g - radius)]


def near_links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect all fingerprints at `radius` or fewer differing bits; `prints` has distinct `fp`."""
    spark = prints.sparkSession
    masks = pigeonhole_masks(prints.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = prints.select("fp", F.explode(keys).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "key")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int")
    # a bucket of more than one tile is compared tile pair by tile pair; side tells the two tiles of a pair apart
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.struct(
            (F.least(F.col("mine"), other) * F.col("tiles") + F.greatest(F.col("mine"), other)).alias("tile"),
            F.when(F.col("mine") == other, 0).when(F.col("mine") < other, 1).otherwise(2).alias("side"),
        ),
    )
    rows = rows.select("key", "fp", tiles.alias("tiles"), mine.alias("mine")).select("key", "fp", F.inline(pairs))
    spread = rows.repartition(shuffle_partitions(spark), "key", "tile").sortWithinPartitions("key", "tile", "fp")
    return spread.mapInArrow(partial(_link_batches, radius=radius), "a long, b long")


def simhash_groups(docs: DataFrame, radius: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate classes of documents by SimHash.

    Texts are lower-cased in A-Z, cut into words at ASCII white space, and hashed as `width`-word shingles with
    repeats (XXH64, `seed`); a text of fewer words is one shingle, one of none has fingerprint zero and links like any
    other. Two fingerprints link at `radius` or fewer differing bits (`radius` is one less than a power of two), and
    classes are connected components. Exact: every link is found whatever the sizes of buckets and groups.

    Returns one row per input row: doc_id, fp (signed 64 bits), fingerprint (16 hex digits) and component_id, the
    smallest doc_id of the class. Null texts are empty; rows without doc_id keep their class, whose id is the smallest
    doc_id that is not null (null if there is none); repeated rows stay; an empty table gives no rows; extra columns
    are ignored.
    """
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = save(prints.mapInArrow(partial(_fingerprint_batches, width=width, seed=seed), "doc_id long, fp long"), "simhash")
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = connected_components(near_links(distinct.select("fp"), radius))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
