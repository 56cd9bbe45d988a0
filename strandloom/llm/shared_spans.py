"""Spans that stand verbatim in more than one record.

A record is cut into variable chunks where its content says so. A gear hash
rolls over it (each character shifts the hash by four bits and adds a number of
its own, so that sixteen characters count); the smallest hash within each
window of the least span length is that window's cut point. Neighbouring
windows with one cut point make up a chunk. Two equal windows have the same cut
point wherever they stand, so insertions move chunks but don't change them, and
any shared window lies in chunks of the same cut hash. Four steps follow:

0. Character groups that are frequent in the whole table (adapters, poly-A,
   phrases of headers) are counted and come last as cut points. A frequent cut
   point would bring unlike chunks of many records together in one task.
1. Cut hashes are counted, without any text; most stand in one record only and
   end here. Those that would bring more chunks to a task than it should hold
   come last too, and are counted again.
2. The chunks of the cut hashes that are left travel with their text, equal ones
   combined by digest to their smallest and largest record id. Tasks get them by cut
   hash. Chunks of several records are shared as a whole; the windows of the
   rest are looked up among the windows of all chunks of that cut hash.
3. The shared stretches are joined back to the records by chunk digest and
   joined to one another within each record.

Digests have 128 bits. What steps 1 and 3 leave out is told by a bit table of bounded size, which
never misses: where it is too small for the data, more rows travel and the
result is the same. No pair of records is ever formed: a chunk that stands in a million records is
one row after step 2 of each batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import materialize

GRAM = 16
SLAB_BITS = 20
_U = np.uint64
_MUL = 0x9E3779B97F4A7C15 | 5
_INV = pow(_MUL, -1, 1 << 64)
_MUL2 = 0xC2B2AE3D27D4EB4F | 5
_INV2 = pow(_MUL2, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _gear(codes: np.ndarray) -> np.ndarray:
    """The number of each character."""
    table = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_MUL))
    if codes.dtype == np.uint8:
        return table[codes]
    return _mix((codes.astype(np.uint64) + _U(1)) * _U(_MUL))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


class Prefix:
    """Digest of any stretch of a slab, from running sums."""

    def __init__(self, g: np.ndarray, second: bool = False):
        """``second``: of other numbers and another base, so that the two together are one digest of 128 bits."""
        g, base, inverse = (_mix(g + _U(_MUL)), _MUL2, _INV2) if second else (g, _MUL, _INV)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * _powers(inverse, len(g)), dtype=np.uint64)])
        self.powers = _powers(base, len(g) + 1)

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.powers[a] ^ _mix((b - a).astype(np.uint64)))


def _rolled(g: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Gear hash of the characters from each place on, and how many it covers."""
    gram = min(GRAM, length)
    h, width = g, 1
    while width * 2 <= gram:
        h = (h[:-width] << _U(4 * width)) + h[width:]
        width *= 2
    return _mix(h), width


class Frequent:
    """A set of hashes with a quick first look."""

    def __init__(self, hashes=()):
        self.hashes = np.unique(np.array(hashes, np.int64).view(np.uint64))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & _U(0xFFFF)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.seen[self._slot(h)])
        out = np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
        out[maybe] = self.hashes[at] == h[maybe]
        return out


def cut_chunks(codes: np.ndarray, breaks: np.ndarray, length: int, frequent: Frequent | None = None):
    """Chunks of a slab: starts, ends and cut hashes, besides the numbers of the characters.

    ``breaks`` marks characters that no span may hold. A chunk is the union of
    the windows of ``length`` characters that have the same cut point.
    """
    n, g = len(codes), _gear(codes)
    windows = n - length + 1
    if windows <= 0:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), g)
    h, width = _rolled(g, length)
    low, top = _U((1 << SLAB_BITS) - 1), _U(1 << 63)
    rank = ((h >> _U(1)) & ~low) | np.arange(len(h), dtype=np.uint64)
    if frequent is not None and len(frequent.hashes):
        rank[frequent.has(h)] |= top
    span, m, reach = length - width + 1, rank, 1
    while reach * 2 <= span:
        m = np.minimum(m[:-reach], m[reach:])
        reach *= 2
    if reach < span:
        m = np.minimum(m[: len(m) - (span - reach)], m[span - reach:])
    cut = (m[:windows] & low).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(breaks)])
    sound = bad[length:length + windows] == bad[:windows]
    new = sound.copy()
    new[1:] &= ~sound[:-1] | (cut[1:] != cut[:-1])
    last = sound.copy()
    last[:-1] &= ~sound[1:] | (cut[1:] != cut[:-1])
    starts, ends = np.flatnonzero(new), np.flatnonzero(last) + length
    return starts, ends, h[cut[starts]], g


def _slabs(batch, length: int, breaks: bytes):
    """Texts of a batch, laid end to end: ids, codes, breaks and where each text begins.

    A slab holds at most 2 ** SLAB_BITS characters. A longer text is cut into
    pieces that overlap by length - 1, so that each window is in one of them.
    """
    most = (1 << SLAB_BITS) - 2
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    kept, total = [], 0
    for i, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        at = 0
        while True:
            piece = t[at:at + most]
            if total + len(piece) + len(kept) > most and kept:
                yield _lay(ids, kept, breaks)
                kept, total = [], 0
            kept.append((i, at, piece))
            total += len(piece)
            if at + most >= len(t):
                break
            at += most - length + 1
    if kept:
        yield _lay(ids, kept, breaks)


def _lay(ids, kept, breaks: bytes):
    joined = "\n".join(p for _, _, p in kept)
    if joined.isascii():
        codes = np.frombuffer(joined.encode("ascii"), np.uint8)
    else:
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(p) for _, _, p in kept], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    bad = np.zeros(len(codes), bool)
    bad[(begin + lengths)[:-1]] = True
    for c in breaks:
        bad |= codes == c
    rows = np.array([i for i, _, _ in kept], np.int64)
    offset = np.array([at for _, at, _ in kept], np.int64)
    return ids[rows], offset, begin, codes, bad


class Bits:
    """A set of hashes as a table of bits: it may hold more than was added, never less."""

    def __init__(self, width: int, table: np.ndarray | None = None):
        self.mask, self.table = _U((1 << width) - 1), np.zeros(1 << (width - 3), np.uint8) if table is None else table

    def _places(self, h: np.ndarray):
        h = h.view(np.uint64)
        return ((h & self.mask).astype(np.int64), (_mix(h) & self.mask).astype(np.int64))

    def add(self, h: np.ndarray) -> None:
        for x in self._places(h):
            np.bitwise_or.at(self.table, x >> 3, np.uint8(1) << (x & 7).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = ((self.table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 for x in self._places(h))
        return (a & b).astype(bool)


def bits_of(hashes: DataFrame, most: int = 27) -> Bits:
    """The one LONG column of ``hashes`` as bits, sixteen for each row but at most 2 ** ``most`` (16 MB)."""
    width = min(most, max(16, (16 * hashes.count()).bit_length()))
    step = 1 << 13

    def blocks(table):
        for k in range(0, len(table), step):
            if table[k:k + step].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([table[k:k + step].tobytes()], pa.binary())], names=["k", "m"])

    def partial(batches):
        own = Bits(width)
        for b in batches:
            own.add(b.column(0).to_numpy(zero_copy_only=False))
        yield from blocks(own.table)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(m, np.uint8)
                sums[k] = sums[k] | x if k in sums else x
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["k", "m"])

    out = Bits(width)
    for k, m in hashes.mapInArrow(partial, "k long, m binary").repartition("k").mapInArrow(merge, "k long, m binary").collect():
        out.table[k:k + len(m)] = np.frombuffer(m, np.uint8)
    return out


def _located(batch, length: int, breaks: bytes, frequent: Frequent | None):
    """For each slab its chunks: record id, offset in the record, cut hash, both ends in the slab; the characters' numbers and the slab itself."""
    for ids, offset, begin, codes, bad in _slabs(batch, length, breaks):
        a, b, cut, g = cut_chunks(codes, bad, length, frequent)
        row = np.searchsorted(begin, a, "right") - 1
        yield ids[row], offset[row] + a - begin[row], cut, a, b, g, codes


def _cut_rows(length: int, breaks: bytes, frequent: Frequent | None):
    """Of each cut hash in a slab the smallest and largest record id and the number of unlike chunks."""

    def run(batches):
        for batch in batches:
            for ids, _, cut, a, b, g, _ in _located(batch, length, breaks, frequent):
                if not len(a):
                    continue
                digest = Prefix(g).digest(a, b)
                order = np.lexsort((digest, cut))
                c, d, i = cut[order], digest[order], ids[order].astype(np.int64)
                new = np.r_[True, c[1:] != c[:-1]]
                first = np.flatnonzero(new)
                unlike = np.add.reduceat((new | np.r_[True, d[1:] != d[:-1]]).astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(c[first].view(np.int64)), pa.array(np.minimum.reduceat(i, first)), pa.array(np.maximum.reduceat(i, first)), pa.array(unlike)], names=["cut", "lo", "hi", "n"])

    return run


def _stretches(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[str]:
    wide = codes.dtype.itemsize
    raw = codes.tobytes()
    how = "ascii" if wide == 1 else "utf-32-le"
    return [raw[x * wide:y * wide].decode(how, "surrogatepass" if wide > 1 else "strict") for x, y in zip(a.tolist(), b.tolist())]


SCHEMA = "cut long, digest long, check long, lo long, hi long, n long, chunk string"
HOT = 20_000


def _merged(t: pa.Table) -> pa.Table:
    """One row per cut hash and digest: the smallest ``lo``, the largest ``hi`` and the sum of ``n``."""
    cut, digest, check = (t[c].to_numpy() for c in ("cut", "digest", "check"))
    order = np.lexsort((check, digest, cut))
    c, d, e = cut[order], digest[order], check[order]
    first = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
    lo = np.minimum.reduceat(t["lo"].to_numpy()[order], first)
    hi = np.maximum.reduceat(t["hi"].to_numpy()[order], first)
    n = np.add.reduceat(t["n"].to_numpy()[order], first)
    one = t.take(pa.array(order[first]))
    return pa.table({"cut": one["cut"], "digest": one["digest"], "check": one["check"], "lo": lo, "hi": hi, "n": n, "chunk": one["chunk"]})


def _chunk_rows(length: int, breaks: bytes, frequent: Frequent | None, wanted: Bits):
    """Chunks of wanted cut hashes, once for each batch; those that repeat within a batch are held back and go out once for many batches."""

    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            for ids, _, cut, a, b, g, codes in _located(batch, length, breaks, frequent):
                keep = wanted.has(cut)
                ids, cut, a, b = ids[keep], cut[keep], a[keep], b[keep]
                if not len(a):
                    continue
                digest, check = Prefix(g).digest(a, b), Prefix(g, True).digest(a, b)
                order = np.lexsort((ids, check, digest))
                d, e = digest[order], check[order]
                first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (e[1:] != e[:-1])])
                last = np.r_[first[1:], len(d)] - 1
                one = order[first]
                t = pa.table(
                    {
                        "cut": cut[one].view(np.int64),
                        "digest": digest[one].view(np.int64),
                        "check": check[one].view(np.int64),
                        "lo": ids[one].astype(np.int64),
                        "hi": ids[order[last]].astype(np.int64),
                        "n": last - first + 1,
                        "chunk": _stretches(codes, a[one], b[one]),
                    }
                )
                again = last > first
                if held is not None:
                    again |= np.isin(t["digest"].to_numpy(), held["digest"].to_numpy())
                yield from t.filter(pa.array(~again)).to_batches()
                if again.any():
                    kept = t.filter(pa.array(again))
                    held = _merged(kept if held is None else pa.concat_tables([held, kept]).combine_chunks())
                    if held.num_rows > HOT:
                        yield from held.to_batches()
                        held = None
        if held is not None:
            yield from held.to_batches()

    return run


def _gram_rows(length: int, share: float):
    """Hashes that hold at least half of ``share`` of a batch's places, with their count; without a hash, all places."""

    def run(batches):
        for batch in batches:
            for _, _, _, codes, bad in _slabs(batch, length, b""):
                h, _ = _rolled(_gear(codes), length)
                unique, n = np.unique(h, return_counts=True)
                often = n >= max(2, share * len(h) / 2)
                yield pa.RecordBatch.from_arrays([pa.array([None, *unique[often].view(np.int64).tolist()], pa.int64()), pa.array([len(h), *n[often].tolist()], pa.int64())], names=["h", "n"])

    return run


def frequent_grams(rows: DataFrame, length: int, share: float = 1e-5) -> Frequent:
    """Character groups with at least ``share`` of all places: at most 1 / share of them.

    They only tell which cut points to avoid; any set gives the same result.
    """
    counted = rows.mapInArrow(_gram_rows(length, share), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    total = counted.filter("h IS NULL").first()
    if total is None:
        return Frequent()
    return Frequent([r.h for r in counted.filter(F.col("h").isNotNull() & (F.col("n") >= max(64.0, share * total.n))).collect()])


def _place_rows(length: int, breaks: bytes, frequent: Frequent | None, found: Bits, hot: Bits, salts: int):
    """Where the chunks with a shared stretch stand; those of hot chunks salted by record."""

    def run(batches):
        for batch in batches:
            for ids, offset, _, a, b, g, _ in _located(batch, length, breaks, frequent):
                digest = Prefix(g).digest(a, b)
                keep = found.has(digest)
                if not keep.any():
                    continue
                digest, ids, offset = digest[keep], ids[keep].astype(np.int64), offset[keep]
                salt = np.where(hot.has(digest), (_mix(ids.view(np.uint64)) % _U(salts)).astype(np.int64), 0)
                check = Prefix(g, True).digest(a[keep], b[keep])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest.view(np.int64)), pa.array(check.view(np.int64)), pa.array(salt), pa.array(ids), pa.array(offset)], names=["digest", "check", "salt", "id", "at"]
                )

    return run


def _salted_rows(hot: Bits, salts: int):
    """The shared stretches, those of hot chunks once for each salt."""

    def run(batches):
        for t in batches:
            times = np.where(hot.has(t.column(0).to_numpy(zero_copy_only=False)), salts, 1)
            row = np.repeat(np.arange(t.num_rows), times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in t.columns), pa.array(salt)], names=[*t.schema.names, "salt"])

    return run


def _runs(flags: np.ndarray):
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def resolve(digest, check, lo, hi, n, chunks: list[str], length: int):
    """Shared stretches of the chunks of one or more cut hashes: digest, check, from, to and the chunk's records (lists).

    A window is shared if the chunks that hold it come from two records.
    """
    digest, check, lo, hi, n = (np.asarray(x, np.int64) for x in (digest, check, lo, hi, n))
    order = np.lexsort((check, digest))
    d, e = digest[order], check[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (e[1:] != e[:-1])])
    d, e, lo, hi, n = d[first], e[first], np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first), np.add.reduceat(n[order], first)
    texts = [chunks[i] for i in order[first].tolist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    whole = lo < hi
    out = [d[whole], e[whole], np.zeros(whole.sum(), np.int64), lengths[whole], n[whole]]
    if whole.all() or len(d) == 1:
        return out
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    per = lengths - length + 1
    which = np.repeat(np.arange(len(d)), per)
    place = np.arange(per.sum()) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    at = begin[which] + place
    g = _gear(codes)
    w, v = Prefix(g).digest(at, at + length), Prefix(g, True).digest(at, at + length)
    o = np.lexsort((v, w))
    f = np.flatnonzero(np.r_[True, (w[o][1:] != w[o][:-1]) | (v[o][1:] != v[o][:-1])])
    several = np.minimum.reduceat(lo[which[o]], f) < np.maximum.reduceat(hi[which[o]], f)
    shared = np.empty(len(w), bool)
    shared[o] = np.repeat(several, np.diff(np.r_[f, len(w)]))
    shared &= ~whole[which]
    # a gap between chunks keeps runs from crossing them
    spread = np.zeros(len(w) + len(d), bool)
    spread[np.arange(len(w)) + which] = shared
    a, b = _runs(spread)
    chunk = np.searchsorted(np.cumsum(per + 1), a, "right")
    shift = (np.cumsum(per + 1) - (per + 1))[chunk]
    more = [d[chunk], e[chunk], a - shift, b - shift + length - 1, n[chunk]]
    return [np.concatenate(x) for x in zip(out, more)]


STRETCHES = "digest long, check long, a long, b long, n long"


def _resolve_rows(length: int):
    """Over batches sorted by cut hash; only the last group is held, its equal chunks merged as it grows."""

    def emit(parts):
        t = pa.Table.from_batches(parts)
        found = resolve(*(t[c].to_numpy() for c in ("digest", "check", "lo", "hi", "n")), t["chunk"].to_pylist(), length)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["digest", "check", "a", "b", "n"])

    def run(batches):
        held = None  # the last group, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            cut = t["cut"].to_numpy()
            tail = int(np.searchsorted(cut, cut[-1], "left"))
            done, rest = t.slice(0, tail), t.slice(tail)
            rest = _merged(rest.combine_chunks()) if rest.num_rows > 1000 else rest
            held = rest.combine_chunks().to_batches()[0]
            if done.num_rows:
                yield from _several(done, cut[:tail], emit)
        if held is not None:
            yield from _several(pa.Table.from_batches([held]), held.column(0).to_numpy(), emit)

    def _several(t, cut, emit):
        """Drops chunks that are alone with their cut hash and come from one record."""
        first = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
        many = np.repeat(np.diff(np.r_[first, len(cut)]) > 1, np.diff(np.r_[first, len(cut)]))
        keep = many | (t["lo"].to_numpy() < t["hi"].to_numpy())
        if keep.any():
            yield emit(t.filter(pa.array(keep)).to_batches())

    return run


def _counted_cuts(rows: DataFrame, length: int, breaks: bytes, frequent: Frequent, most: int) -> tuple[DataFrame, Frequent]:
    """The cut hashes of several records, and the frequent ones, to which those of more than ``most`` unlike chunks are added, at most twice."""
    for last in (False, False, True):
        counted = rows.mapInArrow(_cut_rows(length, breaks, frequent), "cut long, lo long, hi long, n long").groupBy("cut")
        cuts = materialize(counted.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).filter("lo < hi").select("cut", "n"), "cuts")
        # at most one for each ``most`` chunks of the table; the largest, if there are more than a task should be sent
        large = [r.cut for r in cuts.filter(F.col("n") > most).orderBy(F.desc("n")).limit(MOST_FREQUENT).collect()]
        grown = Frequent([*frequent.hashes.view(np.int64).tolist(), *large])
        if last or len(grown.hashes) == len(frequent.hashes):
            return cuts, frequent
        frequent = grown


MOST_FREQUENT = 1_000_000


def shared_stretches(df: DataFrame, id_col: str, text_col: str, length: int = 50, breaks: str = "", most: int = 200_000, slot: int = 1_000_000) -> DataFrame:
    """Columns ``id``, ``span_from``, ``span_to``: what each record shares with others.

    A position is shared if it lies in a span of at least ``length`` characters,
    without any character of ``breaks``, that also stands in a record with
    another id. Overlapping and touching spans are joined; places count from 0
    and ``span_to`` is exclusive. Several rows of one id are one record told
    again: their spans are joined too.

    Rows with a null id or text, and texts shorter than ``length``, have no
    spans. ``most`` is the number of unlike chunks that one task should get for a cut hash,
    ``slot`` of places of one chunk. Texts may be of any length. Equal texts under two ids are shared as a
    whole. Other columns aren't read. An empty table gives an empty result.
    Ids are integers.
    """
    if any(ord(c) > 127 for c in breaks):
        raise ValueError("breaks must be ASCII")
    cuts = breaks.encode()
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.length("text") >= length)
    )
    frequent = frequent_grams(rows, length)
    cut_sizes, frequent = _counted_cuts(rows, length, cuts, frequent, most)
    chunks = rows.mapInArrow(_chunk_rows(length, cuts, frequent, bits_of(cut_sizes.select("cut"))), SCHEMA)
    grouped = chunks.repartition("cut").sortWithinPartitions("cut")
    found = materialize(grouped.mapInArrow(_resolve_rows(length), STRETCHES), "stretches")
    salts = max(1, -(-(found.agg(F.max("n")).first()[0] or 0) // slot))
    hot = bits_of(found.filter(F.col("n") > slot).select("digest").distinct())
    spread = found.mapInArrow(_salted_rows(hot, salts), f"{STRETCHES}, salt long").drop("n")
    places = rows.mapInArrow(_place_rows(length, cuts, frequent, bits_of(found.select("digest")), hot, salts), "digest long, check long, salt long, id long, at long")
    spans = places.join(spread, ["digest", "check", "salt"]).select("id", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    return join_spans(spans)


def join_spans(spans: DataFrame) -> DataFrame:
    """Joins overlapping and touching spans ``a``, ``b`` within each ``id``.

    Nothing is gathered: a running maximum over the sorted spans tells where a
    stretch begins, and sorting spills if it must.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("id").orderBy("a", "b")
    once = spans.distinct()
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = once.withColumn("new", F.when(reach >= F.col("a"), 0).otherwise(1))
    numbered = begun.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "k").agg(F.min("a").alias("span_from"), F.max("b").alias("span_to")).drop("k")
