"""Scalar functions over sequences, CIGAR strings and flags, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SAM flag bits (fixed values of the format).
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}
#: CIGAR operations that use up read bases, and reference bases.
READ_OPS, REFERENCE_OPS, MATCH_OPS = "MIS=X", "MDN=X", "M=X"


def reverse_complement(seq: Column) -> Column:
    """Reverse complement over A, C, G, T, N; null if any other letter occurs."""
    return F.when(~seq.rlike("[^ACGTN]"), F.reverse(F.translate(seq, "ACGTN", "TGCAN")))


def reverse_complement_acgt(seq: Column) -> Column:
    """Reverse complement of the A, C, G and T of a text; all else is left out."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", ""), "ACGT", "TGCA"))


def splice_score(donor: Column, acceptor: Column, forward: Column) -> Column:
    """0 for a canonical splice site pair, 1 for a known other one, 2 for none; reverse strands read complements."""
    site = F.concat(F.when(forward, donor).otherwise(reverse_complement(acceptor)), F.lit("/"), F.when(forward, acceptor).otherwise(reverse_complement(donor)))
    return F.when(site == "GT/AG", 0).when(site.isin("GC/AG", "AT/AC"), 1).otherwise(2)


def cigar(text: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string; "*" has no operations."""
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_string(ops: Column) -> Column:
    return F.when(F.size(ops) == 0, F.lit("*")).otherwise(F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), ""))


def collapse(ops: Column) -> Column:
    """M, = and X become M, and neighbours of one operation are summed."""
    same = F.transform(ops, lambda o: F.struct(o["len"].alias("len"), F.when(o["op"].isin("=", "X"), F.lit("M")).otherwise(o["op"]).alias("op")))
    none = F.array().cast("array<struct<len:int,op:string>>")

    def add(acc: Column, o: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["len"] + o["len"]).alias("len"), o["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == o["op"]), joined).otherwise(F.concat(acc, F.array(o)))

    return F.aggregate(same, none, add)


def ops_length(ops: Column, kinds: str) -> Column:
    """Summed length of the operations in `kinds`."""
    return F.aggregate(F.filter(ops, lambda o: F.lit(kinds).contains(o["op"])), F.lit(0), lambda a, o: a + o["len"])


def ops_count(ops: Column, kinds: str) -> Column:
    return F.size(F.filter(ops, lambda o: F.lit(kinds).contains(o["op"])))


def consumes_read(op: Column) -> Column:
    return F.lit(READ_OPS).contains(op)


def consumes_reference(op: Column) -> Column:
    return F.lit(REFERENCE_OPS).contains(op)


def has_flag(flag: Column, name: str) -> Column:
    return flag.bitwiseAND(F.lit(FLAGS[name])) == FLAGS[name]


def set_flag(flag: Column, name: str, on: Column) -> Column:
    bit = F.lit(FLAGS[name])
    return F.when(on, flag.bitwiseOR(bit)).otherwise(flag.bitwiseAND(F.bitwise_not(bit)))


def pack(index: Column, value: Column, bits: int = 29) -> Column:
    """Index above, value in the low bits, of one long."""
    return F.shiftleft(index.cast("long"), bits).bitwiseOR(value.cast("long"))


def unpack_index(packed: Column, bits: int = 29) -> Column:
    return F.shiftright(packed, bits)


def unpack_value(packed: Column, bits: int = 29) -> Column:
    return packed.bitwiseAND(F.lit((1 << bits) - 1))


def is_forward(seq_index: Column) -> Column:
    return seq_index % 2 == 0


def mirror_index(seq_index: Column) -> Column:
    """The index of the other strand of the same target."""
    return seq_index.bitwiseXOR(F.lit(1))


def region_string(text: Column) -> Column:
    """struct<contig, start, end> of "contig:start-end"; null unless 0 <= start < end."""
    m = lambda g: F.regexp_extract(text, r"^([^:]+):(\d+)-(\d+)$", g)
    ok = text.rlike(r"^[^:]+:\d+-\d+$")
    start, end = m(2).try_cast("long"), m(3).try_cast("long")
    return F.when(ok & (start < end), F.struct(m(1).alias("contig"), start.alias("start"), end.alias("end")))


def attribute(text: Column, key: str) -> Column:
    """The first value of a key in a GTF attribute list, without quotes; null if absent."""
    return F.nullif(F.regexp_extract(text, rf'(?:^|;)\s*{key} "?([^";]*)', 1), F.lit(""))


def duration(nanos: Column) -> Column:
    """Nanoseconds as h, m, s text."""
    s = F.floor(nanos / 1_000_000_000)
    return F.format_string("%02dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def read_id(header: Column) -> Column:
    """A read's name without what follows a space and without /1 or /2."""
    return F.regexp_replace(F.substring_index(header, " ", 1), "/[12]$", "")


def mismatch_budget(length: Column, count: int = -1, share: float = 0.1) -> Column:
    """Allowed mismatches: the count if it is not negative, else the share of the length, rounded down."""
    return F.lit(count) if count >= 0 else F.floor(length * share).cast("int")


def target_overlap(contig: Column, start: Column, end: Column, t_contig: Column, t_start: Column, t_end: Column) -> Column:
    """Where an alignment [start, end) lies: 0 other contig, 1 inside the target, 4 around it, 2 over its left edge,
    3 over its right edge, -1 beside it."""
    return (
        F.when(contig != t_contig, 0)
        .when((start < t_start) & (end > t_end), 4)
        .when((start >= t_start) & (end <= t_end), 1)
        .when((start < t_start) & (end > t_start), 2)
        .when((start < t_end) & (end > t_end), 3)
        .otherwise(-1)
    )


def fasta_lines(seq: Column, width: int = 60) -> Column:
    """A sequence in lines of `width` letters."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), r"\n$", "")
