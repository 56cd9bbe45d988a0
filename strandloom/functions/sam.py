"""SAM fields as Column expressions: flags, bins, mapping quality, CIGAR and MD.

A CIGAR is an array of struct<op string, len int, ref string>; ``ref`` holds
the reference bases of mismatches (op ``X``) and deletions (op ``D``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST, SECONDARY = (1 << i for i in range(9))


def flag(**bits: Column) -> Column:
    """SAM flag from boolean columns named like the constants in lower case; null counts as false."""
    total = F.lit(0)
    for name, c in bits.items():
        total = total + F.when(c, F.lit(globals()[name.upper()])).otherwise(0)
    return total.cast("int")


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def kept_by_model(flags: Column, isize: Column) -> Column:
    """Mapped, in a proper pair, and the mate with insert size >= 0."""
    return has(flags, PROPER) & ~has(flags, UNMAPPED) & (isize >= 0)


def mapq(n_places: Column) -> Column:
    """-10 log10 of the chance to be wrong among ``n_places`` equal ones; 70 if unique, 0 if none."""
    n = n_places.cast("double")
    return F.when(n_places == 1, 70).when(n_places > 1, F.floor(-10 * F.log10(1 - 1 / n))).otherwise(0).cast("int")


def reg2bin(beg: Column, end: Column) -> Column:
    """The bin of the UCSC/BAM scheme for [beg, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(beg, shift) == F.shiftright(last, shift), first + F.shiftright(beg, shift)).otherwise(out)
    return out.cast("int")


def template_length(pos: Column, mate_pos: Column, mate_len: Column, same_ref: Column, first: Column) -> Column:
    """From the first mate's place to the end of its mate on one reference, negated for the last mate; else 0."""
    own = F.when(first, mate_pos + mate_len - pos).otherwise(-(pos + mate_len - mate_pos))
    return F.when(same_ref, own).otherwise(0).cast("int")


def runs_of(ops: Column) -> Column:
    """Run-length form of a text with one operation per base."""
    runs = F.regexp_extract_all(ops, F.lit(r"((.)\2*)"), F.lit(1))
    return F.transform(runs, lambda r: F.struct(F.substring(r, 1, 1).alias("op"), F.length(r).alias("len"), F.lit("").alias("ref")))


def merge_runs(cigar: Column) -> Column:
    """Joins equal neighbours, drops empty operations; after a soft clip that isn't the first all is clipped.

    A fold over the operations, which are as many as a read has runs.
    """

    def entry(op, length, ref):
        return F.struct(op.alias("op"), length.cast("int").alias("len"), ref.alias("ref"))

    def step(acc, x):
        last = F.get(acc, F.size(acc) - 1)
        clipped = (F.size(acc) > 1) & (last["op"] == "S")
        ref = F.when(clipped, "").otherwise(F.concat(last["ref"], F.coalesce(x["ref"], F.lit(""))))
        joined = entry(last["op"], last["len"] + x["len"], ref)
        added = F.array(entry(x["op"], x["len"], F.coalesce(x["ref"], F.lit(""))))
        return F.when(F.size(acc) == 0, added).when(clipped | (last["op"] == x["op"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, added))

    empty = F.array().cast("array<struct<op:string,len:int,ref:string>>")
    return F.aggregate(F.filter(cigar, lambda x: x["len"] > 0), empty, step)


def reverse_cigar(cigar: Column) -> Column:
    """The operations, and the reference bases of each, from the other end."""
    return F.reverse(F.transform(cigar, lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"), F.reverse(x["ref"]).alias("ref"))))


def concat_cigars(a: Column, b: Column) -> Column:
    return merge_runs(F.concat(a, b))


def normalised(cigar: Column) -> Column:
    """Matches and mismatches as ``M``."""
    one = F.transform(cigar, lambda x: F.struct(F.when(x["op"].isin("X", "="), "M").otherwise(x["op"]).alias("op"), x["len"].cast("int").alias("len"), F.lit("").alias("ref")))
    return merge_runs(one)


def cigar_text(cigar: Column) -> Column:
    return F.concat_ws("", F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])))


def edit_count(cigar: Column) -> Column:
    """NM: mismatched, inserted and deleted bases."""
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("X", "I", "D")), F.lit(0), lambda s, x: s + x["len"])


def match_count(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("=", "M")), F.lit(0), lambda s, x: s + x["len"])


def read_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("=", "M", "X", "I", "S")), F.lit(0), lambda s, x: s + x["len"])


def reference_length(cigar: Column) -> Column:
    return F.aggregate(F.filter(cigar, lambda x: x["op"].isin("=", "M", "X", "D", "N")), F.lit(0), lambda s, x: s + x["len"])


def md_text(cigar: Column) -> Column:
    """MD: runs of matches between the reference bases of mismatches and ``^`` deletions."""
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("run"))

    def step(acc, x):
        bases = F.aggregate(F.filter(F.split(x["ref"], ""), lambda c: c != ""), F.struct(acc["s"].alias("s"), acc["run"].alias("run")), lambda b, c: F.struct(F.concat(b["s"], b["run"].cast("string"), c).alias("s"), F.lit(0).alias("run")))
        gone = F.struct(F.concat(acc["s"], acc["run"].cast("string"), F.lit("^"), x["ref"]).alias("s"), F.lit(0).alias("run"))
        more = F.struct(acc["s"].alias("s"), (acc["run"] + x["len"]).cast("int").alias("run"))
        return F.when(x["op"] == "X", bases).when(x["op"] == "D", gone).when(x["op"].isin("=", "M"), more).otherwise(acc)

    return F.aggregate(cigar, zero, step, lambda a: F.concat(a["s"], a["run"].cast("string")))
