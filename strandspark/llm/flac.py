"""FLAC as a media column: a vectorised encoder and decoder for 8-bit mono streams.

Streams are whole FLAC files: marker, STREAMINFO with the MD5 of the samples, a seek table, and frames of one fixed
size with CRC-8 headers and CRC-16 footers. Subframes are fixed linear predictors (order 0 to 4) with Rice-coded
residuals, or verbatim where that is smaller. Many streams are coded together: predictors, Rice parameters and
bit packing are array operations over all samples of a block, and the decoder walks all frames of a block in step.
Samples are the payload bytes less 128, since FLAC's samples are signed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.llm.common import byte_blocks

#: Samples of a frame (the last of a stream may be shorter) and the sample rate that streams declare.
BLOCK, RATE = 4096, 8000
#: Payload bytes coded together.
BATCH_BYTES = 2 << 20
#: Fixed predictors: the weights of the samples before, nearest first, by order.
PREDICTORS = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Rice parameters are four bits; 15 is the escape code.
MAX_RICE = 14
#: The largest parameter that the encoder tries: residuals of 8-bit samples rarely gain from more.
MAX_K = 8


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-16 (polynomial 0x8005) of one byte at each distance from the end, and CRC-8 (0x07) steps."""
    crc8 = np.zeros(256, np.uint8)
    step = np.zeros(256, np.uint32)
    for b in range(256):
        c8, c16 = b, b << 8
        for _ in range(8):
            c8 = (c8 << 1 ^ 0x07 if c8 & 0x80 else c8 << 1) & 0xFF
            c16 = (c16 << 1 ^ 0x8005 if c16 & 0x8000 else c16 << 1) & 0xFFFF
        crc8[b], step[b] = c8, c16
    reach = BLOCK * 2 + 64
    far = np.zeros((reach, 256), np.uint16)
    far[0] = step
    for d in range(1, reach):
        was = far[d - 1].astype(np.uint32)
        far[d] = (was << 8 & 0xFFFF) ^ step[was >> 8]
    return far, crc8


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range of `data`: the checksum is linear, so each byte's share by distance is summed."""
    far, _ = _crc_tables()
    sizes = ends - starts
    at = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(int(sizes.sum()))
    share = far[np.repeat(ends, sizes) - 1 - at, data[at]]
    return np.bitwise_xor.reduceat(share, np.r_[0, np.cumsum(sizes)[:-1]])


def crc8(headers: np.ndarray) -> np.ndarray:
    """CRC-8 of each row of a byte matrix."""
    _, table = _crc_tables()
    crc = np.zeros(len(headers), np.uint8)
    for k in range(headers.shape[1]):
        crc = table[crc ^ headers[:, k]]
    return crc


def _utf8_number(n: int) -> bytes:
    return chr(n).encode() if n < 0xD800 else bytes([0xF0 | n >> 18, 0x80 | n >> 12 & 63, 0x80 | n >> 6 & 63, 0x80 | n & 63]) if n >= 0x10000 else bytes([0xE0 | n >> 12, 0x80 | n >> 6 & 63, 0x80 | n & 63])


def _frame_header(number: int, samples: int) -> bytes:
    """Fixed block size, 16-bit sample count, rate from STREAMINFO, mono, 8 bits."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02]) + _utf8_number(number) + (samples - 1).to_bytes(2, "big")
    return head + bytes([int(crc8(np.frombuffer(head, np.uint8)[None, :])[0])])


def encode(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One FLAC stream for each range of payload bytes."""
    sizes = np.diff(offsets)
    frames = -(-sizes // BLOCK)
    stream = np.repeat(np.arange(len(sizes)), frames)
    number = np.arange(len(stream)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = offsets[:-1][stream] + number * BLOCK
    n = np.minimum(offsets[1:][stream] - start, BLOCK)
    x = payload.astype(np.int32) - 128
    frame_of = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(x)) - start[frame_of]

    # the predictor of the smallest residuals, then the Rice parameter of the fewest bits
    size = []
    r = x
    for order in range(5):
        if order:
            r = np.r_[np.int32(0), r[1:] - r[:-1]]
        size.append(np.where(n > order, np.add.reduceat(np.where(rank >= order, np.abs(r), 0) if order else np.abs(r), start, dtype=np.int64), np.iinfo(np.int64).max))
    order = np.argmin(np.stack(size), axis=0)
    r, u = x, np.zeros(len(x), np.int32)
    for o in range(5):
        if o:
            r = np.r_[np.int32(0), r[1:] - r[:-1]]
        mine = (order == o)[frame_of] & (rank >= o) if (order == o).any() else None
        if mine is not None:
            u = np.where(mine, (r << 1) ^ (r >> 31), u)
    # total bits for each Rice parameter: the unary parts, a stop bit and k bits a residual
    left, k, best = n - order, np.zeros(len(n), np.int64), np.full(len(n), np.iinfo(np.int64).max)
    for try_k in range(MAX_K + 1):
        total = np.add.reduceat(u >> try_k, start, dtype=np.int64) + left * (1 + try_k)
        better = total < best
        best, k = np.where(better, total, best), np.where(better, try_k, k)
    cost = best + 8 * order + 10
    verbatim = 8 * n <= cost
    cost = np.where(verbatim, 8 * n, cost)
    order = np.where(verbatim, 0, order)

    heads = [_frame_header(int(i), int(m)) for i, m in zip(number, n, strict=True)]
    head_len = np.array([len(h) for h in heads], np.int64)
    total_bytes = head_len + 1 + -(-cost // 8) + 2
    frame_at = np.r_[0, np.cumsum(total_bytes)]
    data = np.zeros(int(frame_at[-1]) + 3, np.uint8)
    body = frame_at[:-1] + head_len
    data[body] = np.where(verbatim, 1, 8 + order) << 1  # a zero, six type bits, no wasted bits
    plain = verbatim[frame_of] | (rank < order[frame_of])  # verbatim samples and warm-up samples
    at = np.flatnonzero(plain)
    data[body[frame_of[at]] + 1 + rank[at]] = x[at] & 0xFF
    coded = np.flatnonzero(~verbatim)
    places, values, widths = [(body[coded] + 1 + order[coded]) * 8], [k[coded]], [np.full(len(coded), 10)]  # form 0, one partition
    at = np.flatnonzero(~plain)
    if len(at):
        f = frame_of[at]
        kk, uu = k[f], u[at].astype(np.int64)
        quotient = uu >> kk
        length = quotient + 1 + kk
        ends = np.cumsum(length)
        first = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
        begin = ends - length
        begin += np.repeat(((body + 1 + order) * 8 + 10)[f[first]] - begin[first], np.diff(np.r_[first, len(at)]))
        places.append(begin + quotient)  # the stop bit and the low bits
        values.append(1 << kk | uu & ((1 << kk) - 1))
        widths.append(kk + 1)
    if places:
        place = np.concatenate(places)
        wide = np.concatenate(values) << (24 - np.concatenate(widths) - (place & 7))
        for j in range(3):  # bits of different codes do not overlap, so a byte is the sum of its parts
            data += np.bincount((place >> 3) + j, weights=wide >> (16 - 8 * j) & 0xFF, minlength=len(data)).astype(np.uint8)
    data = data[:-3]
    for f, head in enumerate(heads):
        data[frame_at[f] : frame_at[f] + len(head)] = np.frombuffer(head, np.uint8)
    check = crc16(data, frame_at[:-1], frame_at[1:] - 2)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = check >> 8, check & 0xFF

    out, f0 = [], 0
    raw, signed = data.tobytes(), x.astype(np.int8).tobytes()
    for s, size in enumerate(sizes.tolist()):
        f1 = f0 + int(frames[s])
        lengths = total_bytes[f0:f1]
        points = b"".join(int(number[f] * BLOCK).to_bytes(8, "big") + int(frame_at[f] - frame_at[f0]).to_bytes(8, "big") + int(n[f]).to_bytes(2, "big") for f in range(f0, f1))
        info = BLOCK.to_bytes(2, "big") * 2 + int(lengths.min()).to_bytes(3, "big") + int(lengths.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | size).to_bytes(8, "big") + hashlib.md5(signed[offsets[s] : offsets[s + 1]]).digest()
        blocks = b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(b"fLaC" + blocks + raw[frame_at[f0] : frame_at[f1]])
        f0 = f1
    return out


def undo(samples: np.ndarray, order: int) -> np.ndarray:
    """Samples of a frame whose first `order` are given and whose others are residuals of the fixed predictor."""
    lead = [samples[:order].astype(np.int64)]
    for _ in range(order - 1):
        lead.append(np.diff(lead[-1]))
    part = samples[order:].astype(np.int64)
    for level in range(order - 1, -1, -1):
        part = np.cumsum(part) + lead[level][-1]
    return np.r_[samples[:order], part]


@dataclass
class Frames:
    """Frames found by the seek tables of a block of streams."""

    stream: np.ndarray
    sample: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _metadata(data: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Total samples, MD5, seek points and the place of the first frame."""
    if data[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, info, points = 4, False, b"", b""
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        info, points = (body if kind == 0 else info), (body if kind == 3 else points)
        at += 4 + size
    total = int.from_bytes(info[10:18], "big") & ((1 << 36) - 1)
    seek = [(int.from_bytes(points[i : i + 8], "big"), int.from_bytes(points[i + 8 : i + 16], "big"), int.from_bytes(points[i + 16 : i + 18], "big")) for i in range(0, len(points), 18)]
    return total, info[18:34], seek, at


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes of the streams, one after another, and their offsets. Bad checksums raise ValueError.

    Blocks of PCM are written at the sample offsets of the seek tables, so frames need no order.
    """
    data = np.frombuffer(b"".join(streams), np.uint8)
    base = np.r_[0, np.cumsum([len(s) for s in streams])]
    totals, sums, rows = [], [], []
    for s, stream in enumerate(streams):
        total, md5, seek, first = _metadata(stream)
        totals.append(total)
        sums.append(md5)
        stops = [p[1] for p in seek[1:]] + [len(stream) - first]
        rows += [(s, p[0], p[2], base[s] + first + p[1], base[s] + first + stop) for p, stop in zip(seek, stops, strict=True)]
    offsets = np.r_[0, np.cumsum(np.array(totals, np.int64))]
    fr = Frames(*np.array(rows, np.int64).T)
    stored = data[fr.end - 2].astype(np.uint16) << 8 | data[fr.end - 1]
    if (crc16(data, fr.start, fr.end - 2) != stored).any():
        raise ValueError("a frame's CRC-16 does not match")
    lead = data[fr.start + 4].astype(np.int64)  # the frame number's first byte tells its length
    head = 4 + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))) + 2
    for size in np.unique(head):
        which = np.flatnonzero(head == size)
        rows8 = data[fr.start[which][:, None] + np.arange(size)]
        if (crc8(rows8) != data[fr.start[which] + size]).any() or (rows8[:, :2] != (0xFF, 0xF8)).any():
            raise ValueError("a frame header's CRC-8 does not match")
    bits = np.unpackbits(data)
    data_end = np.r_[data, np.zeros(4, np.uint8)]
    at = (fr.start + head + 1) * 8
    kind = data[fr.start + head + 1] >> 1
    verbatim, order = kind == 1, np.where(kind >= 8, kind.astype(np.int64) - 8, 0)
    if not (verbatim | ((kind >= 8) & (kind <= 12))).all():
        raise ValueError("a subframe of another kind")
    at += 8
    pcm_at = offsets[fr.stream] + fr.sample
    x = np.zeros(int(offsets[-1]), np.int32)
    sample = np.repeat(pcm_at - np.r_[0, np.cumsum(fr.size)[:-1]], fr.size) + np.arange(int(fr.size.sum()))
    f_of = np.repeat(np.arange(len(fr.size)), fr.size)
    rank = sample - pcm_at[f_of]
    plain = np.flatnonzero(verbatim[f_of] | (rank < order[f_of]))
    byte_at = at[f_of[plain]] // 8 + rank[plain]
    x[sample[plain]] = data[byte_at].astype(np.int8)  # subframe headers are whole bytes, so these samples are aligned
    coded = np.flatnonzero(~verbatim)
    if len(coded):
        at = at[coded] + 8 * order[coded]
        k = sum(bits[at + 6 + j].astype(np.int64) << (3 - j) for j in range(4))
        if (sum(bits[at + j].astype(np.int64) for j in range(6)) != 0).any() or (k > MAX_RICE).any():
            raise ValueError("a residual of another form")
        ones = np.flatnonzero(bits).astype(np.int32)
        # the next one at or after each bit, by counting the ones before it
        before = np.cumsum(bits, dtype=np.int32) - bits
        pos, left = at + 10, fr.size[coded] - order[coded]
        by = np.argsort(-left, kind="stable")
        pos, left_by, k_by = pos[by], left[by], k[by]
        live = len(by)
        stops = np.zeros((int(left.max()), len(coded)), np.int32)
        starts = np.zeros_like(stops)
        for t in range(len(stops)):
            while live and left_by[live - 1] <= t:
                live -= 1
            p = pos[:live]
            stop = ones[before[p]]
            starts[t, :live] = p
            stops[t, :live] = stop
            pos[:live] = stop + 1 + k_by[:live]
        # from here on by frame: row-major order is time order within a frame
        done = np.arange(len(stops))[None, :] < left_by[:, None]
        stop, begin, kk = stops.T[done].astype(np.int64), starts.T[done], np.repeat(k_by, left_by)
        low = stop + 1
        wide = data_end[low >> 3].astype(np.int64) << 16 | data_end[(low >> 3) + 1].astype(np.int64) << 8 | data_end[(low >> 3) + 2]
        u = (stop - begin << kk) + (wide >> (24 - (low & 7) - kk) & ((1 << kk) - 1))
        r = (u >> 1) ^ -(u & 1)
        frame = coded[by]
        where = np.repeat((pcm_at + order)[frame] - (np.cumsum(left_by) - left_by), left_by) + np.arange(len(r))
        x[where] = r
        # undo the predictors: residuals of order o are summed o times along their frame, from its warm-up samples
        for o in range(1, 5):
            for f in coded[order[coded] == o].tolist():
                lo, hi = int(pcm_at[f]), int(pcm_at[f] + fr.size[f])
                x[lo:hi] = undo(x[lo:hi], o)
    payload = (x + 128).astype(np.uint8)
    signed = x.astype(np.int8).tobytes()
    for s, md5 in enumerate(sums):
        if hashlib.md5(signed[offsets[s] : offsets[s + 1]]).digest() != md5:
            raise ValueError("the samples' MD5 does not match")
    return payload, offsets


def _payload(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with bytes 0 appended up to a positive multiple of 64."""
    sizes = np.diff(offsets)
    wide = np.maximum(-(-sizes // 64) * 64, 64)
    to = np.r_[0, np.cumsum(wide)]
    out = np.zeros(int(to[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], sizes)] = data
    return out, to


def features(payload: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Mean, standard deviation and zero crossings of the samples, as one string."""
    x = payload.astype(np.int64) - 128
    n = np.diff(offsets)
    total, square = np.add.reduceat(x, offsets[:-1]), np.add.reduceat(x * x, offsets[:-1])
    turn = np.r_[0, (x[1:] >= 0) != (x[:-1] >= 0)].astype(np.int64)
    turn[offsets[:-1]] = 0
    cross = np.add.reduceat(turn, offsets[:-1])
    return [f"mean={a / m:.4f};std={max(b / m - (a / m) ** 2, 0) ** 0.5:.4f};crossings={c}" for a, b, c, m in zip(total.tolist(), square.tolist(), cross.tolist(), n.tolist(), strict=True)]


def _store_batches(batches: Iterable[pa.RecordBatch], keep_media: bool) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in byte_blocks(batches, BATCH_BYTES):
        media = encode(*_payload(data, offsets))
        back, to = decode(media)
        raw = back.tobytes()
        parts = [raw[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
        columns = {
            "doc_id": batch.column("doc_id").cast(pa.int64()),
            "n_bytes": pa.array(np.diff(offsets)),
            "payload_bytes": pa.array(np.diff(to)),
            "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
            "tail_crc32": pa.array([zlib.crc32(p[-64:]) for p in parts], pa.int64()),
            "media_bytes": pa.array([len(m) for m in media], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            "feature": pa.array(features(back, to)),
        }
        if keep_media:
            columns["media"] = pa.array(media, pa.binary())
        yield pa.RecordBatch.from_pydict(columns)


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Store each text's bytes as a FLAC stream, read the stream back and compute features of what was read.

    The payload is the text's UTF-8 bytes with bytes 0 appended up to a positive multiple of 64. Returns one row per
    input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes read back), media_bytes,
    media_sha256, feature and, if asked for, media. Null and empty texts are 64 zeros; a stream does not depend on
    others coded with it, so equal texts give equal values; an empty table gives no rows; extra columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return source.mapInArrow(partial(_store_batches, keep_media=keep_media), schema + (", media binary" if keep_media else ""))
