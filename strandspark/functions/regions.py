"""Region vectors: array<struct<start, end>> columns, half-open, handled by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "array<struct<start:bigint,end:bigint>>"


def region(start: Column, end: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))


def none() -> Column:
    return F.array().cast(KIND)


def _last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def _replace_last(a: Column, end: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(region(_last(a)["start"], end)))


def merge(v: Column, strict: bool = False) -> Column:
    """Sorted union; with `strict` only regions that touch end to start are joined (alignment blocks)."""
    meets = (lambda r, last: r["start"] == last["end"]) if strict else (lambda r, last: r["start"] <= last["end"])
    return F.aggregate(F.array_sort(v), none(), lambda acc, r: F.when((F.size(acc) > 0) & meets(r, _last(acc)), _replace_last(acc, F.greatest(_last(acc)["end"], r["end"]))).otherwise(F.concat(acc, F.array(r))))


def gaps(v: Column) -> Column:
    """Between neighbours, gaps of no length included."""
    return F.when(F.size(v) < 2, none()).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: region(F.get(v, i - 1)["end"], F.get(v, i)["start"])))


def has_gaps(v: Column) -> Column:
    return F.exists(gaps(v), lambda g: g["end"] > g["start"])


def nth_gap(v: Column, n: int) -> Column:
    """The n-th gap (from 0) of some length; null if there is none."""
    return F.get(F.filter(gaps(v), lambda g: g["end"] > g["start"]), F.lit(n))


def gap_index_after(v: Column, pos: Column) -> Column:
    """Index of the first gap whose left end lies behind pos; -1 without one."""
    g = gaps(v)
    found = F.filter(F.transform(g, lambda x, i: F.when((x["start"] > pos) & (x["end"] > x["start"]), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(-1))


def remove(v: Column, start: Column, end: Column) -> Column:
    """The regions without [start, end)."""
    s, e = start.cast("long"), end.cast("long")
    pieces = F.flatten(F.transform(v, lambda r: F.when((r["end"] <= s) | (r["start"] >= e), F.array(r)).otherwise(F.array(region(r["start"], F.least(r["end"], s)), region(F.greatest(r["start"], e), r["end"])))))
    return F.when(s >= e, v).otherwise(F.filter(pieces, lambda r: r["end"] > r["start"]))


def uncovered(v: Column) -> Column:
    """What lies between the first start and the last end without being covered."""
    return F.filter(gaps(merge(v)), lambda g: g["end"] > g["start"])


def length(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def size_left(v: Column, index: Column) -> Column:
    """Covered bases up to and with the region at `index`."""
    return length(F.slice(v, F.lit(1), index + 1))


def size_right(v: Column, index: Column) -> Column:
    return length(F.slice(v, index + 1, F.size(v)))


def region_of_base(v: Column, n: Column) -> Column:
    """Index of the region that holds the n-th covered base (from 0); -1 beyond the end."""
    run = F.transform(v, lambda r, i: size_left(v, i))
    return F.coalesce(F.get(F.filter(F.transform(run, lambda x, i: F.when(x > n, i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))


def lift(pos: Column, source: Column, target: Column) -> Column:
    """A position of one region vector carried over to the vector it is paired with; null if not covered."""
    pairs = F.filter(F.arrays_zip(source.alias("a"), target.alias("b")), lambda p: (p["a"]["start"] <= pos) & (pos < p["a"]["end"]))
    hit = F.get(pairs, F.lit(0))
    return hit["b"]["start"] + pos - hit["a"]["start"]


def overlaps_any(v: Column, start: Column, end: Column, closed: bool = False) -> Column:
    return F.exists(v, lambda r: (r["start"] <= end) & (start < r["end"])) if closed else F.exists(v, lambda r: (r["start"] < end) & (start < r["end"]))


def combine_consecutive(a: Column, b: Column) -> Column:
    """Paired regions, joined where they touch in both vectors: struct<a, b>."""
    start = F.struct(none().alias("a"), none().alias("b"))
    zipped = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def add(acc: Column, p: Column) -> Column:
        touch = (F.size(acc["a"]) > 0) & (_last(acc["a"])["end"] == p["x"]["start"]) & (_last(acc["b"])["end"] == p["y"]["start"])
        put = lambda v, r: F.when(touch, _replace_last(v, r["end"])).otherwise(F.concat(v, F.array(r)))
        return F.struct(put(acc["a"], p["x"]).alias("a"), put(acc["b"], p["y"]).alias("b"))

    return F.aggregate(zipped, start, add)


def valid_gaps(v: Column, most_length: int, most_count: int) -> Column:
    """No gap longer than, and no more gaps than allowed."""
    real = F.filter(gaps(v), lambda g: g["end"] > g["start"])
    return (F.size(real) <= most_count) & F.forall(real, lambda g: g["end"] - g["start"] <= most_length)


def long_anchors(v: Column, least: int) -> Column:
    """Every region is at least so long."""
    return F.forall(v, lambda r: r["end"] - r["start"] >= least)


def from_cigar(pos: Column, ops: Column) -> Column:
    """Read and genome regions of an alignment: struct<read, genome>, one region for each operation that uses both."""
    start = F.struct(F.lit(0).cast("long").alias("r"), pos.cast("long").alias("g"), none().alias("read"), none().alias("genome"))
    uses = lambda o, kinds: F.when(F.lit(kinds).contains(o["op"]), o["len"]).otherwise(0)
    steps = F.transform(ops, lambda o: F.struct(uses(o, "MIS=X").alias("r"), uses(o, "MDN=X").alias("g")))

    def add(acc: Column, o: Column) -> Column:
        r, g = acc["r"] + o["r"], acc["g"] + o["g"]
        both = (o["r"] > 0) & (o["g"] > 0)
        return F.struct(
            r.alias("r"),
            g.alias("g"),
            F.when(both, F.concat(acc["read"], F.array(region(acc["r"], r)))).otherwise(acc["read"]).alias("read"),
            F.when(both, F.concat(acc["genome"], F.array(region(acc["g"], g)))).otherwise(acc["genome"]).alias("genome"),
        )

    return F.aggregate(steps, start, add, lambda acc: F.struct(acc["read"].alias("read"), acc["genome"].alias("genome")))


def text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ",")


def diagonal_gaps(read: Column, genome: Column, mapped_read: Column, mapped_genome: Column) -> Column:
    """Gaps of a diagonal's paired regions that no mapped region overlaps: array<struct<read, genome>>."""
    both = F.arrays_zip(gaps(read).alias("read"), gaps(genome).alias("genome"))
    free = lambda g: ~overlaps_any(mapped_read, g["read"]["start"], g["read"]["end"]) & ~overlaps_any(mapped_genome, g["genome"]["start"], g["genome"]["end"])
    return F.filter(both, lambda g: (g["read"]["end"] > g["read"]["start"]) & free(g))
