"""Second mapping pass: alignments re-routed through the introns that confident pairs have shown.

The introns of a run's targets are few; they travel with the strand sequences. Reads stream through in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandspark.config import MapperConfig
from strandspark.operators.mapping import ALIGNMENTS, TARGET_BYTES, Alignment, ReadMapper, cigar_of, other_strand

#: Share of a read that its main anchor must cover, and of mismatches that an anchor may have.
MIN_ANCHOR_SHARE, MAX_ANCHOR_MISMATCHES = 0.3, 0.2

Path = tuple[tuple[int, int], ...]


class Router:
    """Finds paths along one strand of one target, straight or over introns (start, end)."""

    def __init__(self, seq: str, introns: list[tuple[int, int]]):
        self.seq = seq
        self.introns = sorted(introns)
        self.starts = [s for s, _ in self.introns]
        self.by_end = sorted((e, s) for s, e in self.introns)

    def right(self, pos: int, length: int) -> list[Path]:
        """Region paths of exactly `length` bases from pos on: the plain stretch, and every way over introns."""
        out: list[Path] = []

        def walk(pos: int, left: int, path: Path) -> None:
            if pos + left <= len(self.seq):
                out.append((*path, (pos, pos + left)))
            for k in range(bisect_left(self.starts, pos), len(self.introns)):
                s, e = self.introns[k]
                if s - pos >= left:
                    break
                if (s > pos or not path) and not any(a >= pos and b <= s for a, b in self.introns[:k]):
                    walk(e, left - (s - pos), (*path, (pos, s)) if s > pos else path)

        walk(pos, length, ())
        return list(dict.fromkeys(out))

    def left(self, pos: int, length: int) -> list[Path]:
        """Region paths of exactly `length` bases that end at pos."""
        size = len(self.seq)
        mirror = Router(self.seq[::-1], [(size - e, size - s) for s, e in self.introns])
        return [tuple((size - e, size - s) for s, e in reversed(p)) for p in mirror.right(size - pos, length)]

    def letters(self, path: Path) -> str:
        return "".join(self.seq[s:e] for s, e in path)


def largest_anchor(a: Alignment) -> tuple[int, int, int]:
    """The longest block of at most 20 % mismatches, else the one of the lowest share."""
    share = lambda b: sum(b[0] <= r < b[1] for r in a.mismatches) / (b[1] - b[0])
    good = [b for b in a.blocks if share(b) <= MAX_ANCHOR_MISMATCHES]
    return max(good, key=lambda b: (b[1] - b[0], -b[0])) if good else min(a.blocks, key=lambda b: (share(b), b[0]))


def _best(read: str, router: Router, paths: list[Path]) -> list[tuple[Path, list[int]]]:
    """Paths of the fewest mismatches with the read part, ties kept."""
    scored = [(p, [i for i, (x, y) in enumerate(zip(read, router.letters(p), strict=True)) if x != y]) for p in paths]
    least = min((len(m) for _, m in scored), default=0)
    return [(p, m) for p, m in scored if len(m) == least]


def remap(read: str, a: Alignment, router: Router, mapper: ReadMapper) -> list[Alignment]:
    """Alignments that keep the main anchor and route both ends, within the mismatch and mask limits.

    The anchor is tried whole and cut back to every intron that one of its ends hangs over.
    """
    s, e, g = largest_anchor(a)
    if e - s < MIN_ANCHOR_SHARE * len(read):
        return []
    over_right = {0, *(g + e - s - i for i, j in router.introns if i < g + e - s <= j and g < i)}
    over_left = {0, *(j - g for i, j in router.introns if i <= g < j and j < g + e - s)}
    out: dict[tuple, Alignment] = {}
    for cut_l in sorted(over_left):
        for cut_r in sorted(over_right):
            s2, e2, g2 = s + cut_l, e - cut_r, g + cut_l
            if e2 - s2 < 1:
                continue
            lefts = _best(read[:s2], router, router.left(g2, s2)) if s2 else [((), [])]
            rights = _best(read[e2:], router, router.right(g2 + e2 - s2, len(read) - e2)) if e2 < len(read) else [((), [])]
            inner = [r for r in range(s2, e2) if read[r] != router.seq[g2 + r - s2]]
            for lp, lm in lefts:
                for rp, rm in rights:
                    regions = _join([*lp, (g2, g2 + e2 - s2), *rp])
                    found, at = Alignment(a.seq_index, complete=True), 0
                    for x, y in regions:
                        found.blocks.append((at, at + y - x, x))
                        at += y - x
                    if at != len(read):
                        continue
                    differ = {*lm, *inner, *(e2 + r for r in rm)}
                    place = {r: ReadMapper._place(found, r) for r in differ}
                    if mapper.allowed(found, read, place) and mapper._gaps_fit(found):
                        found.mismatches = differ
                        out.setdefault(tuple(found.blocks), found)
    return list(out.values())


def _join(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in regions:
        if e <= s:
            continue
        if out and out[-1][1] == s:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def shifted(read: str, a: Alignment, router: Router, mapper: ReadMapper) -> list[Alignment]:
    """Variants whose gaps are moved onto introns that lie off by the same number of bases at both ends, with the
    mismatches counted anew."""
    out = []
    for k in range(1, len(a.blocks)):
        (s1, e1, g1), (s2, e2, g2) = a.blocks[k - 1], a.blocks[k]
        if s2 != e1:
            continue
        for i, j in router.introns:
            off = i - (g1 + e1 - s1)
            if off and off == j - g2 and -(e1 - s1) < off < e2 - s2:
                new = a.copy()
                new.blocks[k - 1], new.blocks[k] = (s1, e1 + off, g1), (s2 + off, e2, g2 + off)
                new.mismatches = {r for s, e, g in new.blocks for r in range(s, e) if read[r] != router.seq[g + r - s]}
                if mapper.allowed(new, read, {}):
                    out.append(new)
    return out


def remap_reads(alignments: DataFrame, reads: DataFrame, targets: DataFrame, introns: DataFrame, config: MapperConfig, mask: DataFrame | None = None) -> DataFrame:
    """Second-pass alignments: complete first-pass ones, and all that :func:`remap` and :func:`shifted` find, each once."""
    rows = targets.select("target_id", "seq").orderBy("target_id").collect()  # the loci of a run
    if sum(2 * len(r["seq"]) for r in rows) > TARGET_BYTES:
        raise ValueError("the targets are too large to broadcast; map fewer loci at a time")
    ids = [r["target_id"] for r in rows]
    strands = [s for r in rows for s in (r["seq"].upper(), other_strand(r["seq"].upper()))]
    known: dict[int, list[tuple[int, int]]] = {}
    for r in introns.select("target_id", "start", "end").collect():  # a locus has tens of introns
        size = len(strands[2 * ids.index(r["target_id"])])
        known.setdefault(2 * ids.index(r["target_id"]), []).append((r["start"], r["end"]))
        known.setdefault(2 * ids.index(r["target_id"]) + 1, []).append((size - r["end"], size - r["start"]))
    items = [(r["seq_index"], r["start"], r["end"], r["threshold"]) for r in mask.select("seq_index", "start", "end", "threshold").collect()] if mask is not None else []
    shared = alignments.sparkSession.sparkContext.broadcast((ids, strands, known))
    names = ["read_ord", "mate", "qname", "target_id", "seq_index", "alt", "complete", "pos", "cigar", "mismatches", "anchor", "blocks"]

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, strands, known = shared.value
        mapper = ReadMapper.__new__(ReadMapper)
        mapper.strands, mapper.config, mapper.mask, mapper.postings = strands, config, items, {}
        routers = {i: Router(s, known.get(i, [])) for i, s in enumerate(strands)}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                read = row.seq.upper()
                a = Alignment(row.seq_index, [(b["read_start"], b["read_end"], b["genome_start"]) for b in row.blocks], complete=row.complete)
                router = routers[a.seq_index]
                a.mismatches = {r for s, e, g in a.blocks for r in range(s, e) if read[r] != router.seq[g + r - s]}
                found = remap(read, a, router, mapper) if router.introns else []
                found += [a] if a.complete else []
                if router.introns:
                    found += [v for x in list(found) for v in shifted(read, x, router, mapper)]
                for alt, x in enumerate({tuple(x.blocks): x for x in found}.values()):
                    size = len(router.seq)
                    s, e, g = x.blocks[-1] if x.seq_index % 2 else x.blocks[0]
                    pos = size - (g + e - s) if x.seq_index % 2 else g
                    out.append((row.read_ord, row.mate, row.qname, ids[x.seq_index // 2], x.seq_index, row.alt * 1000 + alt, True, pos, cigar_of(x, config), len(x.mismatches), min(q - p for p, q, _ in x.blocks), [{"read_start": p, "read_end": q, "genome_start": z} for p, q, z in x.blocks]))
            yield pd.DataFrame(out, columns=names)

    with_seq = alignments.join(reads.select("read_ord", "mate", "seq"), ["read_ord", "mate"])
    mapped = with_seq.select("read_ord", "mate", "qname", "seq_index", "alt", "complete", "blocks", "seq").mapInPandas(work, ALIGNMENTS)
    # the same alignment may come from several first-pass ones
    same = W.partitionBy("read_ord", "mate", "seq_index", "pos", "cigar").orderBy("alt")
    return mapped.withColumn("__rn", F.row_number().over(same)).where("__rn = 1").drop("__rn")
