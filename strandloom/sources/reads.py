"""FASTQ and FASTA as splittable Python data sources, and pairing of mate files.

``spark.dataSource.register(FastqSource)`` makes ``format("fastq")`` known. A
plain file is split into byte ranges; each task moves on to the first border of
records in its range and reads up to the first one past its end. A gzipped file is
one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandloom.functions.seq import fake_quality
from strandloom.sources import files

SPLIT = 64 << 20
ROWS = 10_000


class Range(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int):
        super().__init__((path, number, start, end))
        self.path, self.number, self.start, self.end = path, number, start, end


def _text(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode("latin-1")


_LETTERS = re.compile(rb"[A-Za-z.*-]+")


class _Lines:
    """Lines of a file with their places, looked at ahead and three lines back."""

    def __init__(self, f, place: int):
        self.f, self.place, self.lines, self.at = f, place, [], 0

    def line(self, k: int) -> bytes | None:
        """The line ``k`` places on from the current one; None past the end."""
        while self.at + k >= len(self.lines):
            x = self.f.readline()
            if not x:
                return None
            self.lines.append((self.place, x))
            self.place += len(x)
        return self.lines[self.at + k][1]

    def begins(self) -> int:
        return self.lines[self.at][0]

    def move(self, n: int) -> None:
        self.at += n
        if self.at > 4096:
            del self.lines[: self.at - 3]
            self.at = 3

    def record(self, k: int = 0) -> bool:
        """Whether the four lines from place ``k`` on can be nothing but a record: a sequence of letters begins neither a record nor a ``+`` line."""
        if self.at + k < 0:
            return False
        head = self.line(k)
        if not head or head[:1] != b"@":
            return False
        seq, plus, qual = self.line(k + 1), self.line(k + 2), self.line(k + 3)
        if qual is None or plus[:1] != b"+":
            return False
        s = seq.rstrip(b"\r\n")
        return len(s) == len(qual.rstrip(b"\r\n")) and _LETTERS.fullmatch(s) is not None

    def border(self) -> bool:
        """Whether every reading of the file, from wherever it began, comes by this line: a record that no other one overlaps."""
        return self.record() and not self.record(-3)


def _before(f, start: int) -> int:
    """A place at least three lines before the first line that begins at or after ``start``."""
    back = 1 << 12
    while start > back:
        f.seek(start - back)
        block = f.read(back)
        first = block.find(b"\n")
        if first >= 0 and block.count(b"\n") > 4:
            return start - back + first + 1
        back *= 4
    return 0


def fastq_records(f, start: int, end: int):
    """(name, seq, qual, problem) of the records from the first border in [start, end) up to the first one from ``end`` on.

    A record needs a sequence, a ``+`` line and a quality as long as the
    sequence; one without is given with its problem, up to where the next sound
    record begins, and a line that begins no record is given as ``header``.
    Blank lines between records don't count. Borders are told by the lines around them
    alone, so splits of any size give the records of one split.
    """
    if start:
        place = _before(f, start)
        f.seek(place)
        x = _Lines(f, place)
        while x.line(0) is not None and x.begins() < end and not (x.begins() >= start and x.border()):
            x.move(1)
        if x.line(0) is None or x.begins() >= end:
            return
    else:
        x = _Lines(f, 0)
    while (head := x.line(0)) is not None:
        if x.begins() >= end and x.border():
            return
        if not head.strip():
            x.move(1)
            continue
        if head[:1] != b"@":
            yield _text(head), None, None, "header"
            x.move(1)
            continue
        n = 4 if x.record() else next((k for k in (1, 2, 3) if x.record(k)), 4)
        rest = [x.line(k) if k < n else None for k in (1, 2, 3)]
        seq, plus, qual = (y or b"" for y in rest)
        name, s, q = _text(head)[1:], _text(seq), _text(qual)
        yield name, s, q, "sequence" if not s else "plus" if plus[:1] != b"+" else "quality" if len(s) != len(q) else None
        x.move(min(n, 1 + sum(y is not None for y in rest)))


def fasta_records(f, start: int, end: int):
    """(header, seq) of the records whose ``>`` is in [start, end); sequences may take many lines."""
    if start:
        f.seek(start - 1)
        f.readline()
    head, parts, place = None, [], f.tell()
    while True:
        line = f.readline()
        if not line or line[:1] == b">":
            if head is not None:
                yield head, "".join(parts)
            if not line or place >= end:
                return
            head, parts = _text(line)[1:], []
        elif head is not None:
            parts.append(_text(line).strip())
        place += len(line)


class _Reader(DataSourceReader):
    def __init__(self, options, kind: str):
        self.paths, self.split, self.kind = files.expand(options["path"]), int(options.get("split", SPLIT)), kind

    def partitions(self):
        return [Range(p, k, a, b) for p in self.paths for k, (a, b) in enumerate(files.splits(p, self.split))]

    def read(self, part):
        import pyarrow as pa

        def batch(rows):
            cols = list(zip(*rows))
            if self.kind == "fastq":
                names, types = ["file", "split", "idx", "name", "seq", "qual", "problem"], [pa.string(), pa.int32(), pa.int64()] + [pa.string()] * 4
            else:
                names, types = ["file", "split", "idx", "name", "seq"], [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        records = fastq_records if self.kind == "fastq" else fasta_records
        rows = []
        with files.open_binary(part.path) as f:
            i = 0
            for r in records(f, part.start, part.end):
                stray = self.kind == "fastq" and r[3] == "header"
                rows.append((part.path, part.number, None if stray else i, *r))
                i += not stray
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class FastqSource(DataSource):
    """Options: ``path`` (list by commas, globs), ``split`` (bytes of a split)."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return "file string, split int, idx long, name string, seq string, qual string, problem string"

    def reader(self, schema):
        return _Reader(self.options, "fastq")


class FastaSource(DataSource):
    """As ``FastqSource``; ``name`` is the whole header line."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return "file string, split int, idx long, name string, seq string"

    def reader(self, schema):
        return _Reader(self.options, "fasta")


def register(spark: SparkSession) -> None:
    for source in (FastqSource, FastaSource):
        spark.dataSource.register(source)


def scan(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Records of FASTQ or FASTA files (told by the first byte), with the columns of ``FastqSource``."""
    register(spark)
    kind = files.sniff(files.expand(path)[0])
    df = spark.read.format(kind).option("split", split).load(path)
    if kind == "fasta":
        df = df.withColumn("qual", F.lit(None).cast("string")).withColumn("problem", F.when(F.length("seq") == 0, "sequence"))
    return df


def sound(df: DataFrame) -> DataFrame:
    return df.filter(F.col("problem").isNull() & F.col("name").isNotNull() & F.col("seq").isNotNull())


def with_ordinals(df: DataFrame) -> DataFrame:
    """Adds ``ordinal``, the record's number in its file; lines that begin no record have none.

    Only the counts of the splits go through a window; records keep their place.
    """
    counts = df.groupBy("file", "split").agg(F.count("idx").alias("__n"))
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "split", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__base"))
    return df.join(F.broadcast(base), ["file", "split"]).withColumn("ordinal", F.col("__base") + F.col("idx")).drop("__base")


def zipped(spark: SparkSession, left: list[str], right: list[str]) -> DataFrame:
    """Records of both files side by side: ``lane``, ``ordinal`` and, for each mate, ``name``, ``seq``, ``qual`` and ``problem``.

    Files pair by their order, records by their number; malformed records keep
    their number, so that they don't shift the pairing. A mate that isn't there has
    the problem ``missing``.
    """
    if len(left) != len(right):
        raise ValueError("each file of first mates needs one of second mates")
    lanes = []
    for lane, (a, b) in enumerate(zip(left, right), 1):
        if a == b:
            raise ValueError(f"{a} is given for both mates")
        if files.sniff(a) != files.sniff(b):
            raise ValueError(f"{a} and {b} differ in format")
        one, two = (
            with_ordinals(scan(spark, p)).filter("ordinal IS NOT NULL").select("ordinal", F.col("name").alias(f"name{k}"), F.upper("seq").alias(f"seq{k}"), fake_quality(F.col("seq"), F.col("qual")).alias(f"qual{k}"), F.col("problem").alias(f"problem{k}"), F.lit(True).alias(f"__{k}"))
            for k, p in ((1, a), (2, b))
        )
        both = one.join(two, "ordinal", "full_outer").withColumn("lane", F.lit(lane))
        for k in (1, 2):
            both = both.withColumn(f"problem{k}", F.when(F.col(f"__{k}").isNull(), "missing").otherwise(F.col(f"problem{k}"))).drop(f"__{k}")
        lanes.append(both)
    out = lanes[0]
    for x in lanes[1:]:
        out = out.unionByName(x)
    return out


def pairs(spark: SparkSession, left: list[str], right: list[str], strict: bool = False) -> DataFrame:
    """The sound pairs of ``zipped``: ``lane``, ``ordinal``, ``name1``, ``seq1``, ``qual1``, ``name2``, ``seq2``, ``qual2``.

    Pairs of which a mate is missing or malformed are left out (``unpaired``
    has them), or with ``strict`` an error.
    """
    out = zipped(spark, left, right)
    bad = F.col("problem1").isNotNull() | F.col("problem2").isNotNull()
    if strict:
        out = out.withColumn("seq1", F.when(bad, F.raise_error(F.lit("the files of mates differ in length, or a record is malformed"))).otherwise(F.col("seq1")))
    else:
        out = out.filter(~bad)
    return out.drop("problem1", "problem2")


def unpaired(both: DataFrame) -> DataFrame:
    """How many pairs of ``zipped`` are left out, by lane and the mates' problems."""
    return both.filter("problem1 IS NOT NULL OR problem2 IS NOT NULL").groupBy("lane", "problem1", "problem2").agg(F.count(F.lit(1)).alias("n"))
