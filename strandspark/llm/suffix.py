"""Exact removal of repeated byte strings with a run-length index.

Every string of `length` bytes holds at least one anchor: a k-byte window whose hash is smallest among those of the
string. Equal strings have equal anchors at equal places, so only the surroundings of anchors that occur twice can
repeat. Anchors are exchanged as packed arrays, one row for each task and bucket, after each task has kept only the
first of its equal surroundings; so a passage that a third of all documents share costs each task one entry.

Where one anchor has several different surroundings, their bytes meet in one bucket and a run-length index is built
over them: the Burrows-Wheeler transform is run-compressed, the suffix positions and the common prefix lengths are
sampled at the run ends, and matching statistics (for every position the neighbouring suffix and the length that it
shares) are streamed from the samples alone. Positions that share `length` bytes form chains; all but the earliest of a
chain start a repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import byte_blocks, forget, give_back, save, shuffle_partitions

#: Bytes of an anchor.
ANCHOR = 32
#: Text bytes hashed at once, and text bytes whose anchors a task gathers before it sends them.
BLOCK_BYTES, SEND_BYTES = 1 << 20, 32 << 20
#: Bytes of surroundings looked at at once (those of one anchor stay together).
INDEX_BYTES = 2 << 20
#: Text bytes that a bucket of anchors should stand for.
BUCKET_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_ANY_DOC = (1 << 63) - 1
ENTRY = np.dtype([("anchor", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("tag", "<u4"), ("pos", "<u4")])
SPAN = np.dtype([("start", "<i8"), ("end", "<i8")])


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of bytes, and powers of the base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(20)
    inverse = pow(_BASE, -1, 1 << 64)
    power = np.full(size, _BASE, np.uint64)
    back = np.full(size, inverse, np.uint64)
    power[0] = back[0] = 1
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.cumprod(power), np.cumprod(back)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """take over values[i : i + width] for every i, by doubling; positions past the end are left out."""
    out, have = values, 1
    while have * 2 <= width:
        out = take(out[:-have], out[have:])
        have *= 2
    return take(out[: len(values) - width + 1], out[width - have : width - have + len(values) - width + 1]) if have < width else out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a byte block: (text, position in the text, anchor hash, hash of the surroundings)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    value, power, back = _tables(max(len(data) + 1, BLOCK_BYTES + 1))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * power[: len(data)], out=total[1:])
    window = length - k + 1
    h = _mix((total[k:] - total[:-k]) * back[: len(data) - k + 1])
    least = _sliding(h, window, np.minimum)  # smallest hash of the string that starts at each byte
    sizes = np.diff(offsets)
    first = np.repeat(offsets[:-1], sizes)
    end = np.repeat(offsets[1:], sizes)
    inside = np.arange(len(least)) + length <= end[: len(least)]
    least = np.where(inside, least, np.uint64(0))
    wide = np.r_[np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)]
    chosen = np.flatnonzero(h == _sliding(wide, window, np.maximum)[: len(h)])
    text = np.searchsorted(offsets, chosen, "right") - 1
    lo = np.maximum(chosen - (length - k), first[chosen])
    hi = np.minimum(chosen + length, end[chosen])
    around = _mix((total[hi] - total[lo]) * back[lo] + _mix(((chosen - lo) << 20 | (hi - chosen)).astype(np.uint64)))
    return text, chosen - offsets[text], h[chosen], around


def _merge(starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by document: (doc, start, end) of the maximal spans."""
    order = np.lexsort((starts, docs))
    d, s, e = docs[order], starts[order], ends[order]
    if not len(d):
        return d, s, e
    group = np.cumsum(np.r_[0, d[1:] != d[:-1]])
    shift = group * (int(e.max()) + 2)
    reach = np.maximum.accumulate(e + shift)
    new = np.r_[True, (s + shift)[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return d[at], s[at], (reach - shift)[np.r_[at[1:], len(d)] - 1]


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.r_[np.flatnonzero(new), n]


def _span_rows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One (doc, tag, packed maximal spans) for each document."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    first = _cuts(doc, tag)
    text, s, e = _merge(start, end, np.repeat(np.arange(len(first) - 1), np.diff(first)))
    packed = np.empty(len(text), SPAN)
    packed["start"], packed["end"] = s, e
    cut = _cuts(text)
    return [(int(doc[first[text[a]]]), int(tag[first[text[a]]]), packed[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _rows(kind: str, rows: list[tuple[int, int, bytes]], buckets: int = 0) -> pa.RecordBatch:
    """Rows (bucket, key, tag, kind, data); rows of documents travel through the bucket of their key."""
    key = [r[0] for r in rows]
    to = [k % buckets for k in key] if buckets else [0] * len(key)
    columns = [pa.array(to, pa.int64()), pa.array(key, pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([kind] * len(rows), pa.string()), pa.array([r[2] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "key", "tag", "kind", "data"])


def _planes(entry: np.ndarray) -> bytes:
    """Records byte plane by byte plane: the planes of small numbers' high bytes are zeros, which compress away."""
    return np.ascontiguousarray(entry.view(np.uint8).reshape(len(entry), -1).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(ENTRY.itemsize, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(ENTRY)


def _exchange(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, kind, data): packed anchors by bucket ("anchors"), and spans already known by document ("spans").

    Of equal surroundings only the task's first is sent; the others repeat it, which is all that must be known.
    """
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    read = 0

    def flush() -> Iterator[pa.RecordBatch]:
        entry, size = np.concatenate(held), np.concatenate(sizes)
        held.clear()
        sizes.clear()
        if not len(entry):  # no text is as long as a string
            return
        order = np.lexsort((entry["pos"], entry["tag"], entry["doc"], entry["around"], entry["anchor"]))
        entry, size = entry[order], size[order]
        again = np.r_[False, (entry["anchor"][1:] == entry["anchor"][:-1]) & (entry["around"][1:] == entry["around"][:-1])]
        # a row of the same document at the same place is no earlier start
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(entry))))
        twin = again & (entry["doc"] == entry["doc"][lead]) & (entry["tag"] == entry["tag"][lead]) & (entry["pos"] == entry["pos"][lead])
        late = again & ~twin
        at = entry["pos"][late].astype(np.int64)
        spans = _span_rows(entry["doc"][late], entry["tag"][late], np.maximum(at - (length - ANCHOR), 0), np.minimum(at + length, size[late]))
        yield _rows("spans", spans, buckets)
        keep = entry[~again]
        to = (keep["anchor"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        keep, to = keep[order], to[order]
        cut = _cuts(to)
        yield _rows("anchors", [(int(to[a]), 0, _planes(keep[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], buckets)

    for batch, data, offsets in byte_blocks(batches, BLOCK_BYTES):
        docs, tags = batch.column("key").to_numpy(), batch.column("tag").to_numpy()
        text, pos, anchor, around = anchors(data, offsets, length)
        entry = np.empty(len(text), ENTRY)
        entry["anchor"], entry["around"], entry["doc"], entry["tag"], entry["pos"] = anchor, around, docs[text], tags[text], pos
        held.append(entry)
        sizes.append(np.diff(offsets)[text])
        read += len(data)
        if read >= SEND_BYTES:
            yield from flush()
            read = 0
    if held:
        yield from flush()
    give_back()


def _resolve(rows: pa.Table) -> pa.Table:
    """A bucket's anchors: repeats of one surrounding need no text ("covered"), anchors with several surroundings have
    the first of each asked for ("asked"). Spans pass through."""
    mark = rows.column("kind").combine_chunks().to_numpy(zero_copy_only=False) == "anchors"
    packed = rows.column("data").filter(pa.array(mark)).to_pylist()
    out = [rows.filter(pa.array(~mark)).combine_chunks()]
    if not packed:
        return out[0]
    entry = np.concatenate([_from_planes(p) for p in packed])
    order = np.lexsort((entry["pos"], entry["tag"], entry["doc"], entry["around"], entry["anchor"]))
    entry = entry[order]
    new_anchor = np.r_[True, entry["anchor"][1:] != entry["anchor"][:-1]]
    new_around = new_anchor | np.r_[True, entry["around"][1:] != entry["around"][:-1]]
    lead = np.maximum.accumulate(np.where(new_around, np.arange(len(entry)), 0))
    late = ~new_around & ~((entry["doc"] == entry["doc"][lead]) & (entry["tag"] == entry["tag"][lead]) & (entry["pos"] == entry["pos"][lead]))
    group = np.cumsum(new_anchor) - 1
    many = np.bincount(group[new_around], minlength=group[-1] + 1)[group] > 1
    for kind, which in (("covered", late), ("asked", new_around & many)):
        e = entry[which]
        e = e[np.lexsort((e["pos"], e["tag"], e["doc"]))]
        cut = _cuts(e["doc"], e["tag"])
        pairs = np.empty(len(e), SPAN)
        pairs["start"], pairs["end"] = e["pos"], e["anchor"].view(np.int64)
        found = [(int(e["doc"][a]), int(e["tag"][a]), pairs[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        out.append(pa.Table.from_batches([_rows(kind, found)]))
    return pa.concat_tables([out[0].cast(out[1].schema), *out[1:]])


def _cut_out(batches: Iterable[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Surroundings asked for, as rows (bucket, packed [doc, start, length, anchor, tag], bytes): one for each bucket and document."""
    for batch, data, offsets in byte_blocks(batches, BLOCK_BYTES):
        raw = data.tobytes()
        keys, heads, texts = [], [], []
        for i, (doc, tag, asked) in enumerate(zip(batch.column("key").to_pylist(), batch.column("tag").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
            pairs = np.concatenate([np.frombuffer(p, SPAN) for p in asked])
            pairs = pairs[np.lexsort((pairs["start"], pairs["end"]))]
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            a = np.maximum(lo + pairs["start"] - (length - ANCHOR), lo)
            b = np.minimum(lo + pairs["start"] + length, hi)
            to = (pairs["end"].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            for bucket in np.unique(to).tolist():
                which = np.flatnonzero(to == bucket)
                keys.append(bucket)
                heads.append(np.stack([np.full(len(which), doc), a[which] - lo, b[which] - a[which], pairs["end"][which], np.full(len(which), tag)], axis=1).astype(np.int64).tobytes())
                texts.append(b"".join([raw[x:y] for x, y in zip(a[which].tolist(), b[which].tolist(), strict=True)]))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(heads, pa.binary()), pa.array(texts, pa.binary())], ["bucket", "head", "bytes"])


class RunLengthIndex:
    """Run-length index of texts: BWT runs with suffix positions and common prefix lengths sampled at run ends.

    Texts are joined with a mark of its own after each, so no common prefix passes the end of a text.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        count = len(offsets) - 1
        sizes = np.diff(offsets)
        symbol = np.empty(len(data) + count, np.int64)
        marks = offsets[1:] + np.arange(count)
        is_mark = np.zeros(len(symbol), bool)
        is_mark[marks] = True
        symbol[~is_mark] = data.astype(np.int64) + count
        symbol[marks] = np.arange(count)
        self.symbol, self.starts, self.sizes, self.depth = symbol, marks - sizes, sizes, depth
        suffix = self._suffix_order(symbol, int(sizes.max(initial=0)) + 1)
        n = len(suffix)
        bwt = symbol[suffix - 1]
        head = np.r_[True, bwt[1:] != bwt[:-1]] if n else np.zeros(0, bool)
        at = np.flatnonzero(head)
        self.run_symbol, self.run_length = bwt[at], np.diff(np.r_[at, n])
        # samples: at each run's first row, the suffix and the last suffix of the run before, and what they share
        before = suffix[at - 1]
        sample, self.length_at = suffix[at], self._common(suffix[at], before)
        if len(at):
            self.length_at[0] = 0
        order = np.argsort(sample)
        self.sample, self.before, self.length_at = sample[order], before[order], self.length_at[order]

    @staticmethod
    def _suffix_order(symbol: np.ndarray, depth: int) -> np.ndarray:
        """Suffix order by prefix doubling; marks differ, so ranks are distinct once `depth` symbols are looked at.

        As many symbols as a number holds are looked at first. A rank is the first place of its group in the order, so
        groups of one keep theirs, and each round sorts the others alone.
        """
        n = len(symbol)
        if not n:
            return np.zeros(0, np.int64)
        bits = int(symbol.max() + 1).bit_length()
        have = min(62 // bits, n)
        key = symbol + 1
        for j in range(1, have):
            key <<= bits
            key[: n - j] += symbol[j:] + 1
        order = np.argsort(key)
        key, live = key[order], np.arange(n)
        rank = np.empty(n, np.int64)
        while True:
            # live: places of the groups that were sorted; key: by what
            new = np.r_[True, key[1:] != key[:-1]]
            rank[order[live]] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
            live = live[~(new & np.r_[new[1:], True])]
            if have >= depth or not len(live):
                return order
            suffix = order[live]
            after = suffix + have
            key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
            to = np.argsort(key)
            order[live], key = suffix[to], key[to]
            have *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths; the marks differ, so they end within the longest text."""
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(a != b)
        wide = np.r_[self.symbol, -1 - np.arange(2)]
        k = 0
        while len(live):
            live = live[wide[a[live] + k] == wide[b[live] + k]]
            out[live] += 1
            k += 1
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For every position the suffix before it in order, and what they share.

        Between samples both follow by steps: the neighbour moves on by one and the shared length falls by one.
        """
        at = np.searchsorted(self.sample, np.arange(len(self.symbol)), "right") - 1
        step = np.arange(len(self.symbol)) - self.sample[at]
        return self.before[at] + step, self.length_at[at] - step

    def repeats(self, order_key: np.ndarray) -> np.ndarray:
        """Positions whose `depth` bytes also start at a position with a smaller order key."""
        n = len(self.symbol)
        near, shared = self.matching_statistics()
        root = np.where(shared >= self.depth, near, np.arange(n))
        while True:  # follow chains of shared strings to their first suffix
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, order_key)
        return np.flatnonzero(order_key > least[root])


def _index_bucket(rows: pa.Table, length: int) -> pa.Table:
    """Spans of a bucket's surroundings that repeat what starts earlier in another: anchor by anchor, as many anchors
    to an index as INDEX_BYTES hold."""
    head = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 5) for h in rows.column("head").to_pylist()])
    data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
    offsets = np.r_[0, np.cumsum(head[:, 2])]
    order = np.lexsort((head[:, 1], head[:, 4], head[:, 0], head[:, 3]))
    ends = np.flatnonzero(np.r_[head[order[1:], 3] != head[order[:-1], 3], True]) + 1  # of the anchors
    size = np.cumsum(head[order, 2])
    found, at = [], 0
    while at < len(order):
        before = size[at - 1] if at else 0
        whole = ends[(ends > at) & (size[ends - 1] <= before + INDEX_BYTES)]
        to = int(whole[-1]) if len(whole) else int(ends[ends > at][0])
        mine = order[at:to]
        sizes = head[mine, 2]
        own = np.r_[0, np.cumsum(sizes)]
        text = data[np.repeat(offsets[mine] - own[:-1], sizes) + np.arange(int(own[-1]))]
        keep = _with_shared_string(text, own, length)
        if keep.any():
            text, mine = text[np.repeat(keep, sizes)], mine[keep]
            found.append(_repeated_starts(RunLengthIndex(text, np.r_[0, np.cumsum(sizes[keep])], length), head[mine]))
        at = to
    if not found:
        return pa.Table.from_batches([_rows("spans", [])])
    doc, tag, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.Table.from_batches([_rows("spans", _span_rows(doc, tag, pos, pos + length))])


def _with_shared_string(text: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """Surroundings with a string of `length` bytes whose hash occurs twice: only those can repeat another."""
    if len(text) < length:
        return np.zeros(len(own) - 1, bool)
    value, power, back = _tables(max(len(text) + 1, BLOCK_BYTES + 1))
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(value[text] * power[: len(text)], out=total[1:])
    h = (total[length:] - total[:-length]) * back[: len(text) - length + 1]
    of = np.repeat(np.arange(len(own) - 1), np.diff(own))[: len(h)]
    inside = np.flatnonzero(np.arange(len(h)) + length <= own[of + 1])
    order = inside[np.argsort(h[inside])]
    same = h[order[1:]] == h[order[:-1]]
    keep = np.zeros(len(own) - 1, bool)
    keep[of[order[1:][same]]] = keep[of[order[:-1][same]]] = True
    return keep


def _repeated_starts(index: RunLengthIndex, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, tag, pos) of the starts of strings that also start earlier."""
    text = np.repeat(np.arange(len(head)), index.sizes + 1)
    pos = head[text, 1] + np.arange(len(index.symbol)) - index.starts[text]
    doc, tag = head[text, 0], head[text, 4]
    # starts ordered by document and place, as numbers
    order = np.lexsort((head[:, 4], head[:, 0]))
    first = _cuts(head[order, 0], head[order, 4])
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = index.repeats(number[text] << 32 | pos)
    return doc[found], tag[found], pos[found]


def _finish(batches: Iterable[pa.RecordBatch], length: int, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in byte_blocks(batches, BLOCK_BYTES):
        raw = data.tobytes()
        removed, spans, sha, kept = [], [], [], []
        for i, (covered, known) in enumerate(zip(batch.column("covered").to_pylist(), batch.column("spans").to_pylist(), strict=True)):
            lo, hi = int(offsets[i]), int(offsets[i + 1])
            text = raw[lo:hi]
            parts = [np.frombuffer(p, SPAN) for p in known or []]
            for p in covered or []:
                near = np.frombuffer(p, SPAN)["start"]
                part = np.empty(len(near), SPAN)
                part["start"], part["end"] = np.maximum(near - (length - ANCHOR), 0), np.minimum(near + length, hi - lo)
                parts.append(part)
            if not parts:
                removed.append(0)
                spans.append(0)
                kept.append(text)
            else:
                all_ = np.concatenate(parts)
                _, s, e = _merge(all_["start"], all_["end"], np.zeros(len(all_), np.int64))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                kept.append(b"".join([text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)]))
            sha.append(hashlib.sha256(kept[-1]).hexdigest())
        columns = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if keep_text:
            columns, names = [*columns, pa.array(kept, pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False) -> DataFrame:
    """Remove every byte covered by a string of `length` bytes that also starts earlier in the corpus.

    Earlier means a smaller doc_id, or the same doc_id and an earlier place; matches never cross documents, overlaps
    count, and strings are judged on the input. Returns one row per input row: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept_sha256 and, if asked for, the remaining bytes. Null and empty texts have no bytes; rows
    equal in doc_id and text are one document, so the same place in them is not earlier; rows that repeat a doc_id with
    another text are documents of their own, in the order of a 31-bit hash of their texts; rows without doc_id come last,
    likewise; an empty table gives no rows; extra columns are ignored.
    """
    if length < 2 * ANCHOR:
        raise ValueError(f"strings of at least {2 * ANCHOR} bytes")
    spark = docs.sparkSession
    tag = F.coalesce(F.xxhash64("text"), F.lit(0)).bitwiseAND(F.lit((1 << 31) - 1)).alias("tag")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = source.select(F.coalesce("doc_id", F.lit(_ANY_DOC)).alias("key"), tag, "doc_id", "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    schema = "bucket long, key long, tag long, kind string, data binary"
    sent = keyed.select("key", "tag", "text").mapInArrow(partial(_exchange, length=length, buckets=buckets), schema)
    solved = save(sent.groupBy("bucket").applyInArrow(lambda rows: _resolve(rows), schema).drop("bucket"), "resolved")
    asked = solved.where("kind = 'asked'").groupBy("key", "tag").agg(F.collect_list("data").alias("asked"))
    firsts = keyed.join(asked, ["key", "tag"]).select("key", "tag", "text", "asked")
    cut = firsts.mapInArrow(partial(_cut_out, length=length, buckets=buckets), "bucket long, head binary, bytes binary")
    matched = cut.groupBy("bucket").applyInArrow(lambda rows: _index_bucket(rows, length), schema).drop("bucket")
    when = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("data"))).alias(kind)
    spans = save(matched.unionByName(solved.where("kind <> 'asked'")).groupBy("key", "tag").agg(when("covered"), when("spans")), "spans")
    forget(solved)
    joined = keyed.join(spans, ["key", "tag"], "left").select("doc_id", "text", "covered", "spans")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(partial(_finish, length=length, keep_text=keep_text), out)
