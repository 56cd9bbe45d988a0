"""Sequence functions as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 31


def codes(seq: Column) -> Column:
    """Bases as digits A0 C1 G2 T3, any case; every other character is 4."""
    known = F.translate(F.upper(seq), "ACGT", "0123")
    return F.regexp_replace(known, "[^0-3]", "4")


def kmer_code(kmer: Column) -> Column:
    """A k-mer (k <= 31, upper case) as a LONG of two bits per base; null if it holds other characters."""
    packed = F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")
    return F.when(kmer.rlike("^[ACGT]+$"), packed)


def kmer_text(code: Column, k: int = K) -> Column:
    """The k-mer of a code."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def reverse_complement(seq: Column) -> Column:
    """Reversed, with A-T and C-G exchanged, case kept; other characters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def reverse_code(code: Column, k: int = K) -> Column:
    """The code of the reverse complement of a k-mer's code."""
    return kmer_code(reverse_complement(kmer_text(code, k)))


def fake_quality(seq: Column, qual: Column) -> Column:
    """``qual``, or ``A`` for each base where there is none."""
    return F.coalesce(qual, F.repeat(F.lit("A"), F.length(seq)))


def strip_mate(name: Column) -> Column:
    """A read name without its mate suffix (``/1`` or ``/2`` at the end)."""
    return F.regexp_replace(name, "/[12]$", "")


def first_token(header: Column) -> Column:
    """The name in a header line: what stands before the first blank."""
    return F.split(header, r"\s", 2).getItem(0)


def bucket(pos: Column, length: Column, buckets: int = 64) -> Column:
    """Which of ``buckets`` equal parts of a target a position from 0 lies in, from 1."""
    return (F.floor(pos * buckets / length) + 1).cast("int")


def noise_likelihood(length: Column) -> Column:
    """Likelihood of a read of random bases."""
    return F.pow(F.lit(0.25), length)
