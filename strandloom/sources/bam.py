"""SAM text and BAM: a codec of its own (BGZF is deflate with an extra field), as data source and sink."""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from strandloom.sources import files

SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, nm int, md string, score int"
BLOCK = 0xFF00
#: Fixed values of the format: the end-of-file block, base codes and CIGAR operations.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"


def bgzf_block(data: bytes, level: int = -1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<2I", zlib.crc32(data), len(data))


def bgzf_blocks(data: bytes, level: int = -1) -> bytes:
    return b"".join(bgzf_block(data[k:k + BLOCK], level) for k in range(0, len(data), BLOCK))


def bgzf_read(f):
    """Uncompressed bytes block by block; each is checked."""
    while len(head := f.read(18)) == 18:
        yield inflate(f.read(struct.unpack("<H", head[16:18])[0] - 17))


def header(references: list[tuple[str, int]], command: str = "") -> bytes:
    lines = ["@HD\tVN:1.0\tSO:unsorted"] + [f"@SQ\tSN:{n}\tLN:{k}" for n, k in references] + [f"@PG\tID:strandloom\tCL:{command}"]
    text = ("\n".join(lines) + "\n").encode()
    out = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(references))
    for n, k in references:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    return out


def parse_cigar(text: str | None) -> list[tuple[int, str]]:
    out, n = [], 0
    for c in "" if text in (None, "*") else text:
        if c.isdigit():
            n = n * 10 + int(c)
        else:
            out.append((n, c))
            n = 0
    return out


def _bin(beg: int, end: int) -> int:
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == end >> shift:
            return first + (beg >> shift)
    return 0


def encode(r, ids: dict[str, int]) -> bytes:
    """One record; positions count from 1 as in SAM, 0 means none."""
    ops = parse_cigar(r["cigar"])
    seq, pos = r["seq"] or "", (r["pos"] or 0) - 1
    span = sum(n for n, o in ops if o in "MDN=X")
    name = (r["qname"] or "*").encode() + b"\0"
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2))
    qual = bytes(ord(c) - 33 for c in r["qual"]) if r["qual"] and r["qual"] != "*" else b"\xff" * len(seq)
    tags = b""
    for tag, key in (("NM", "nm"), ("AS", "score")):
        if r[key] is not None:
            tags += tag.encode() + b"i" + struct.pack("<i", r[key])
    if r["md"]:
        tags += b"MDZ" + r["md"].encode() + b"\0"
    next_id = ids.get(r["rname"], -1) if r["rnext"] == "=" else ids.get(r["rnext"], -1)
    core = struct.pack("<iiBBHHHiiii", ids.get(r["rname"], -1), pos, len(name), r["mapq"] or 0, _bin(pos, pos + max(span, 1)) if pos >= 0 else 4680, len(ops), r["flag"] or 0, len(seq), next_id, (r["pnext"] or 0) - 1, r["tlen"] or 0)
    body = core + name + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def decode(body: bytes, names: list[str]) -> tuple:
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32
    name = body[at:at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    half = body[at:at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in half)[:l_seq]
    at += len(half)
    q = body[at:at + l_seq]
    at += l_seq
    tags: dict[str, object] = {}
    while at < len(body):
        tag, kind = body[at:at + 2].decode(), chr(body[at + 2])
        at += 3
        if kind == "Z":
            end = body.index(b"\0", at)
            tags[tag], at = body[at:end].decode(), end + 1
        elif kind == "A":
            tags[tag], at = chr(body[at]), at + 1
        else:
            fmt = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}.get(kind)
            if fmt is None:
                break
            tags[tag] = struct.unpack_from("<" + fmt, body, at)[0]
            at += struct.calcsize(fmt)
    rname = names[ref] if ref >= 0 else "*"
    rnext = "=" if next_ref == ref and ref >= 0 else names[next_ref] if next_ref >= 0 else "*"
    qual = "*" if q[:1] == b"\xff" else "".join(chr(c + 33) for c in q)
    return (name, flag, rname, pos + 1, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", rnext, next_pos + 1, tlen, seq or "*", qual, tags.get("NM"), tags.get("MD"), tags.get("AS"))


class _Stream:
    """Uncompressed bytes of a BAM file from a block on, with the place in the file of the block that each byte came from."""

    def __init__(self, f, place: int = 0):
        self.f, self.buf, self.at = f, b"", 0
        self.blocks: list[tuple[int, int]] = []  # (bytes before the block's first one, place of the block)
        self.read_, self.dropped, self.next = 0, 0, place
        f.seek(place)

    def need(self, n: int) -> bool:
        parts, have = [], len(self.buf) - self.at
        while have < n:
            head = self.f.read(18)
            if len(head) < 18:
                break
            size = struct.unpack("<H", head[16:18])[0] + 1
            data = inflate(self.f.read(size - 18))
            self.blocks.append((self.read_, self.next))
            self.next, self.read_, have = self.next + size, self.read_ + len(data), have + len(data)
            parts.append(data)
        if parts:
            self.dropped += self.at
            self.buf, self.at = b"".join([self.buf[self.at:], *parts]), 0
        return have >= n

    def take(self, n: int) -> bytes:
        if not self.need(n):
            raise ValueError("BAM file ends early")
        self.at += n
        return self.buf[self.at - n:self.at]

    def block(self) -> int:
        """Place of the block in which the next byte stands."""
        here = self.dropped + self.at
        while len(self.blocks) > 1 and self.blocks[1][0] <= here:
            self.blocks.pop(0)
        return self.blocks[0][1] if self.blocks and self.blocks[0][0] <= here < self.read_ else self.next

    def offset(self) -> int:
        """Of the next byte in its block."""
        place = self.block()
        return self.dropped + self.at - self.blocks[0][0] if self.blocks and self.blocks[0][1] == place else 0


def inflate(rest: bytes) -> bytes:
    data = zlib.decompress(rest[:-8], -15)
    crc, n = struct.unpack("<2I", rest[-8:])
    if n != len(data) or crc != zlib.crc32(data):
        raise ValueError("damaged BGZF block")
    return data


def _header(x: _Stream) -> list[tuple[str, int]]:
    if x.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    x.take(struct.unpack("<i", x.take(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", x.take(4))[0]):
        name = x.take(struct.unpack("<i", x.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", x.take(4))[0]))
    return refs


def _plausible(x: _Stream, skip: int, refs) -> int:
    """Size of what may be a record ``skip`` bytes on; 0 if it can't be one, -1 at the end of the file."""
    if not x.need(skip + 36):
        return -1 if len(x.buf) - x.at == skip else 0
    n, ref, pos, l_name, _, _, n_ops, _, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", x.buf, x.at + skip)
    least = 32 + l_name + 4 * n_ops + (l_seq + 1) // 2 + l_seq
    if not (-1 <= ref < len(refs) and -1 <= next_ref < len(refs) and l_name > 0 and 0 <= l_seq and pos >= -1 and next_pos >= -1 and least <= n < 1 << 28):
        return 0
    if (ref >= 0 and pos > refs[ref][1]) or not x.need(skip + 36 + l_name):
        return 0
    name = x.buf[x.at + skip + 36:x.at + skip + 36 + l_name]
    return n + 4 if name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def _first_record(x: _Stream, refs) -> bool:
    """Moves to the first place from which several records follow each other; False if there is none in the file."""
    while x.need(1):
        skip, seen = 0, 0
        while seen < 5:
            n = _plausible(x, skip, refs)
            if n <= 0:
                break
            skip, seen = skip + n, seen + 1
        if seen == 5 or (seen and n == -1):
            return True
        x.at += 1
    return False


def _first_block(f, start: int, end: int) -> int | None:
    """Place of the first BGZF block that begins in [start, end): its head, and that of the block behind it."""
    f.seek(start)
    data, place = f.read(1 << 18), start
    while data:
        k = data.find(b"\x1f\x8b\x08\x04")
        while 0 <= k and place + k < end:
            f.seek(place + k)
            head = f.read(18)
            if len(head) == 18 and head[12:16] == b"BC\x02\x00":
                f.seek(place + k + struct.unpack("<H", head[16:18])[0] + 1)
                after = f.read(4)
                if after in (b"", b"\x1f\x8b\x08\x04"):
                    return place + k
            k = data.find(b"\x1f\x8b\x08\x04", k + 1)
        if place + len(data) >= end:
            return None
        place += len(data) - 3
        f.seek(place)
        data = f.read(1 << 18)
    return None


def records(f):
    """The reference table, then each record of an open BAM file."""
    x = _Stream(f)
    refs = _header(x)
    yield refs
    names = [n for n, _ in refs]
    while x.need(4):
        yield decode(x.take(struct.unpack("<i", x.take(4))[0]), names)


class _Split(InputPartition):
    def __init__(self, path: str, start: int, end: int, offset: int, refs):
        super().__init__((path, start))
        self.path, self.start, self.end, self.offset, self.refs = path, start, end, offset, refs


def split_records(f, start: int, end: int, offset: int, refs):
    """Records that begin in blocks that begin in [start, end); ``offset``: where the first one is in the block at ``start``, -1 to look for it."""
    place = start if offset >= 0 else _first_block(f, start, end)
    if place is None:
        return
    x = _Stream(f, place)
    if offset >= 0:
        if offset:
            x.take(offset)
    elif not _first_record(x, refs):
        return
    names = [n for n, _ in refs]
    while x.need(4) and x.block() < end:
        yield decode(x.take(struct.unpack("<i", x.take(4))[0]), names)


HEADER, END = "0-header", "z-end"


class _BamReader(DataSourceReader):
    """A task for each stretch of some bytes of a file; a folder of parts has its header in a file of its own."""

    def __init__(self, options):
        self.paths, self.split = files.expand(options["path"]), int(options.get("split", 32 << 20))

    def partitions(self):
        out = []
        for p in self.paths:
            folder = files.is_folder(p)
            with files.open_binary(f"{p}/{HEADER}" if folder else p) as f:
                x = _Stream(f)
                refs = _header(x)
                first, offset = (x.block(), x.offset()) if x.need(1) else (x.next, 0)
            for q in sorted(files.expand(f"{p}/part-*")) if folder else [p]:
                a, at = (0, 0) if folder else (first, offset)
                n = files.size(q)
                for k, b in enumerate(range(a, max(n, a + 1), self.split)):
                    out.append(_Split(q, b, min(b + self.split, n), at if k == 0 else -1, refs))
        return out

    def read(self, part):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32()}
        fields = [(c.split()[0], kinds[c.split()[1]]) for c in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

        rows = []
        with files.open_binary(part.path) as f:
            for r in split_records(f, part.start, part.end, part.offset, part.refs):
                rows.append(r)
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class _Part(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _BamWriter(DataSourceWriter):
    """Tasks write BGZF parts into the folder ``path`` through the path's own file system; blocks end with records.

    The commit adds the header and the end block, so that the files of the
    folder in order of name are a BAM file. With ``single`` they are joined
    to one, which the driver has to copy.
    """

    def __init__(self, options, overwrite: bool):
        self.path, self.level = options["path"].rstrip("/"), int(options.get("level", -1))
        self.references = [(n, int(k)) for n, k in (x.rsplit(":", 1) for x in options.get("references", "").split("\t") if x)]
        self.command, self.single = options.get("command", ""), options.get("single", "true").lower() == "true"
        if not overwrite and files.exists(self.path):
            raise FileExistsError(self.path)
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}" if self.single else self.path
        files.remove(self.folder)

    def write(self, rows):
        from pyspark import TaskContext

        ids = {n: k for k, (n, _) in enumerate(self.references)}
        ctx = TaskContext.get()
        part = f"{self.folder}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        held, size = [], 0
        with files.create_binary(part) as f:
            for r in rows:
                one = encode(r.asDict(), ids)
                if size + len(one) > BLOCK and held:
                    f.write(bgzf_blocks(b"".join(held), self.level))
                    held, size = [], 0
                held.append(one)
                size += len(one)
            if held:
                f.write(bgzf_blocks(b"".join(held), self.level))
        return _Part(part)

    def commit(self, messages):
        kept = sorted(m.path for m in messages if m)
        begin = bgzf_blocks(header(self.references, self.command), self.level)
        if self.single:
            files.remove(self.path)
            with files.create_binary(self.path) as out:
                out.write(begin)
                for p in kept:
                    with files.open_binary(p) as f:
                        while data := f.read(16 << 20):
                            out.write(data)
                out.write(EOF)
            files.remove(self.folder)
            return
        names = {p.rpartition("/")[2] for p in kept}
        for p in files.expand(f"{self.folder}/part-*"):
            if p.rpartition("/")[2] not in names:
                files.remove(p)  # of attempts that failed
        for name, data in ((HEADER, begin), (END, EOF)):
            with files.create_binary(f"{self.folder}/{name}") as out:
                out.write(data)

    def abort(self, messages):
        files.remove(self.folder)


class BamSource(DataSource):
    """Options: ``path``, ``split`` (bytes of a split); for writing ``references`` (name:length, by tabs), ``level``, ``command``, ``single``."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _BamReader(self.options)

    def writer(self, schema, overwrite):
        return _BamWriter(self.options, overwrite)


def read_bam(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("split", split).load(path)


def references(path: str) -> list[tuple[str, int]]:
    with files.open_binary(f"{path}/{HEADER}" if files.is_folder(path) else path) as f:
        return _header(_Stream(f))


def write_bam(df: DataFrame, path: str, refs: list[tuple[str, int]], level: int = -1, command: str = "", single: bool = True) -> None:
    """One BAM file, or with ``single=False`` a folder of parts, to which no data goes through the driver."""
    if level not in (-1, *range(1, 10)):
        raise ValueError("level is -1 or 1 to 9")
    df.sparkSession.dataSource.register(BamSource)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    df.select(*columns).write.format("bam").mode("overwrite").option("references", "\t".join(f"{n}:{k}" for n, k in refs)).option("level", level).option("command", command).option("single", str(single).lower()).save(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text with the columns of the BAM source; header lines are left out."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("@"))
    f = F.split("value", "\t")
    names = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    tags = [F.nullif(F.regexp_extract("value", rf"\t{t}:[iZ]:([^\t]+)", 1), F.lit("")).cast(kinds[c]).alias(c) for c, t in (("nm", "NM"), ("md", "MD"), ("score", "AS"))]
    return lines.select(*[f.getItem(i).cast(kinds[n]).alias(n) for i, n in enumerate(names)], *tags)


def sam_lines(df: DataFrame) -> DataFrame:
    """One text column ``value`` of SAM lines."""
    core = [F.coalesce(F.col(c).cast("string"), F.lit("*" if c in ("qname", "rname", "cigar", "rnext", "seq", "qual") else "0")) for c in ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")]
    tags = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:{k}:"), F.col(c).cast("string"))) for c, t, k in (("nm", "NM", "i"), ("md", "MD", "Z"), ("score", "AS", "i"))]
    return df.select(F.concat_ws("\t", *core, *tags).alias("value"))
