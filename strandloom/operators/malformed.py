"""Loading of delimited read lines with malformed rows set apart.

Blocks of lines go through Arrow's CSV parser at once. A block that it rejects
is halved again and again until the bad lines stand alone in small leaves, and
only those leaves go through the strict line parser, which names every fault.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("name", "seq", "qual", "lane", "mate")
LEAF = 12
MOST_BYTES = 1 << 30

_LINE = r'(?s)\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\z'
_RULES = {
    "name": r"\A[!-~]+\z",
    "seq": r"\A[ACGTNacgtn]+\z",
    "qual": r"\A[!-~]*\z",
    "lane": r"\A[1-8]\z",
    "mate": r"\A[12]\z",
}
_STRICT = {k: re.compile(v.replace(r"\A", "").replace(r"\z", "")) for k, v in _RULES.items()}
_FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",]*)')


def split_line(line: str) -> list[str] | None:
    """The unquoted fields of a line, or None if its quoting is broken."""
    fields, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        at = m.end()
        if at < len(line) and line[at] != ",":
            return None
        fields.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        if at == len(line):
            return fields
        at += 1


def diagnose(line: str | None) -> tuple[list[str] | None, list[str]]:
    """Fields (None if they can't be told apart) and faults of one line."""
    if line is None:
        return None, ["columns"]
    fields = split_line(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return None, ["quoting"]
    if len(fields) != len(FIELDS):
        return None, ["columns"]
    faults = [k for k, v in zip(FIELDS, fields) if not _STRICT[k].fullmatch(v)]
    if len(fields[1]) != len(fields[2]) and "qual" not in faults:
        faults.append("qual")
    return fields, sorted(faults, key=FIELDS.index)


def _bulk(lines: pa.Array) -> pa.Table | None:
    """The fields of a block, or None if the parser finds any line of it out of order.

    A running number before each line proves that every record of the parser is one line.
    """
    n = len(lines)
    if lines.nbytes > MOST_BYTES:
        return None
    numbered = pc.binary_join_element_wise(pc.cast(pa.array(np.arange(n)), pa.string()), lines, ",")
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), numbered), "\n")
    data = whole.cast(pa.binary())[0].as_buffer()
    try:
        t = pcsv.read_csv(
            pa.BufferReader(data),
            read_options=pcsv.ReadOptions(column_names=["i", *FIELDS], block_size=max(len(data) + 1, 1024), use_threads=False),
            parse_options=pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={"i": pa.int64(), **dict.fromkeys(FIELDS, pa.string())}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if t.num_rows != n or not np.array_equal(t["i"].to_numpy(), np.arange(n)):
        return None
    return t.drop_columns(["i"])


def _sound(t: pa.Table) -> np.ndarray:
    """For each row, whether all its values are valid."""
    ok = pc.equal(pc.utf8_length(t["seq"]), pc.utf8_length(t["qual"]))
    for k, rule in _RULES.items():
        ok = pc.and_(ok, pc.match_substring_regex(t[k], rule))
    return ok.to_numpy().astype(bool)


def parse_block(lines: pa.Array) -> tuple[list[pa.Array], pa.Array]:
    """The fields of each line of a block, null where it has a fault, and the lists of faults.

    Valid lines stay in Arrow from end to end; Python sees the leaves only.
    """
    n = len(lines)
    good: list[tuple[np.ndarray, list]] = []
    faults: dict[int, list[str]] = {}

    def strictly(rows) -> None:
        kept = []
        for i in rows.tolist():
            fields, found = diagnose(lines[i].as_py())
            if found:
                faults[i] = found
            else:
                kept.append((i, fields))
        if kept:
            good.append((np.array([i for i, _ in kept]), [pa.chunked_array([pa.array(c, pa.string())]) for c in zip(*(f for _, f in kept))]))

    stripped = pc.replace_substring_regex(lines, r"\r\z", "")
    # a parser more lenient than the rules can't accept what the pattern forbids
    regular = pc.fill_null(pc.match_substring_regex(stripped, _LINE), False).to_numpy(zero_copy_only=False)
    strictly(np.flatnonzero(~regular))
    rows = np.flatnonzero(regular)
    stripped = stripped.take(pa.array(rows))
    todo = [(0, len(rows))]
    while todo:
        a, b = todo.pop()
        if b - a <= LEAF:
            strictly(rows[a:b])
            continue
        t = _bulk(stripped.slice(a, b - a))
        if t is None:
            m = (a + b) // 2
            todo += [(m, b), (a, m)]
            continue
        ok = _sound(t)
        strictly(rows[a:b][~ok])
        kept = t.filter(pa.array(ok))
        good.append((rows[a:b][ok], [kept[k] for k in FIELDS]))
    where = np.full(n, -1)
    if good:
        found = np.concatenate([i for i, _ in good])
        where[found] = np.arange(len(found))
    take = pa.array(where, mask=where < 0)
    fields = [pa.chunked_array([c for _, cols in good for c in cols[k].chunks], pa.string()).combine_chunks().take(take) for k in range(len(FIELDS))]
    count = np.zeros(n + 1, np.int32)
    bad = sorted(faults)
    count[np.array(bad, np.int64) + 1] = [len(faults[i]) for i in bad]
    return fields, pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array([x for i in bad for x in faults[i]], pa.string()))


def parse_lines(df: DataFrame, id_col: str = "raw_id", line_col: str = "line") -> DataFrame:
    """One row per input row: its id, the typed fields and ``faults``.

    * ``faults`` is empty for a valid line; otherwise the fields are null.
    * A null line has the fault ``columns``; so has an empty one.
    * A null id is kept. Repeated lines are rows of their own.
    * Other columns of ``df`` are left out, so none can clash with the result.
    * An empty table gives an empty result. Lines may be of any length.

    Nothing is shuffled: each task parses the blocks of its own split.
    """
    id_type = df.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            lines = batch.column(1)
            if pa.types.is_large_string(lines.type):
                lines = lines.cast(pa.string())
            (name, seq, qual, lane, mate), faults = parse_block(lines)
            columns = [batch.column(0), name, seq, qual, lane.cast(pa.int32()), mate.cast(pa.int8()), faults]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *FIELDS, "faults"])

    schema = T.StructType(
        [T.StructField("id", id_type)]
        + [T.StructField(k, T.StringType()) for k in FIELDS[:3]]
        + [T.StructField("lane", T.IntegerType()), T.StructField("mate", T.ByteType()), T.StructField("faults", T.ArrayType(T.StringType()))]
    )
    return df.select(F.col(id_col).alias("id"), F.col(line_col).alias("line")).mapInArrow(run, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    """The typed rows of ``parse_lines`` without a fault."""
    return parsed.filter(F.size("faults") == 0).select("id", *FIELDS, F.length("seq").alias("len"))


def fault_rows(parsed: DataFrame) -> DataFrame:
    """One row per fault of ``parse_lines``: id and reason."""
    return parsed.select("id", F.explode("faults").alias("reason"))
