"""Files of any size read in byte ranges: lines, and CSV records.

A file is cut into ranges of ``RANGE`` bytes, one row each, and dealt to the
tasks.  A range gives the lines (records) that *start* in it, and reads on
past its end to finish the last one.  Each is named by its byte offset in the
file, which is the same however often, and by whichever task, it is read.

In CSV files a line end inside quotes ends no record.  Whether a range starts
inside quotes depends on all bytes before it, but only by one bit: a range
either keeps or flips the quote state, so its transition function is the
parity of its quotes, and an exclusive scan of the parities over a file's
ranges (one small row each) gives every range its state.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casepipe.session import checkpoint

RANGE = 32 << 20
#: Bytes read at once past a range's end, and most tasks of one read.
AHEAD = 1 << 16
TASKS = 20_000
WAVES = 8
#: Folders that a task lists, at most about.
FOLDERS = 20_000
BATCH = 20_000
_FEED, _RETURN, _QUOTE = 10, 13, 34


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, path: str, depth: int | None = None) -> DataFrame:
    """``(file, length)`` of the files under ``path`` (which may be a pattern),
    at any depth or in folders exactly ``depth`` levels below it.  As for Spark's
    readers, names that start with ``.``, or with ``_`` and hold no ``=``, are none.

    Tasks list the folders, one level after the other; the driver learns how
    many there are, not their names.
    """
    from pyspark.errors import AnalysisException

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(conf).globStatus(pattern)
    if not found:
        raise AnalysisException(f"Path does not exist: {path}")
    top = [(s.getPath().toString(), None if s.isDirectory() else s.getLen()) for s in found if s.isDirectory() or not _hidden(s.getPath().getName())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for folder in b.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(_uri(folder))
                rows = []
                for x in system.get_file_info(fs.FileSelector(name, recursive=False)):
                    if not _hidden(x.base_name):
                        rows.append((f"{folder.rstrip('/')}/{x.base_name}", x.size if x.is_file else None))
                yield from _rows(iter(rows), ("file", "length"), (pa.string(), pa.int64()))

    schema = "file string, length long"
    level, files, at = spark.createDataFrame(top, schema), [], 0
    while True:
        if depth is None or depth == at:
            files.append(level.where("length IS NOT NULL"))
        folders = level.where("length IS NULL").select("file")
        if depth == at or not (n := folders.count()):
            break
        tasks = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, n // FOLDERS)))
        level = checkpoint(folders.repartition(tasks).mapInArrow(run, schema))
        at += 1
    out = files[0]
    for more in files[1:]:
        out = out.unionByName(more)
    return out


def byte_ranges(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, int]:
    """``(file, lo, hi, length)`` of all files under ``path`` at any depth,
    whose contents are not read, dealt to tasks; and the number of tasks: one
    for each ``size`` bytes, so small files share tasks, but of ranges below
    ``RANGE`` no more than ``WAVES`` a core, as two shuffles of them follow."""
    files = list_files(spark, path).where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("file", "length", starts.alias("lo"))
    ranges = ranges.select("file", "lo", F.least(F.col("lo") + size, "length").alias("hi"), "length")
    n, total = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    waves = min(n, WAVES * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(n, TASKS, max(2 * spark.sparkContext.defaultParallelism, -(-total // max(size, RANGE)), min(waves, -(-total // size)))))
    return ranges.repartition(tasks, "file", "lo"), tasks


def _uri(file: str) -> str:
    """Hadoop's name of a file, whose characters stand for themselves, as a URI."""
    scheme, _, rest = file.partition(":")
    host, _, name = rest[2:].partition("/") if rest.startswith("//") else ("", "", rest[1:])
    return f"{scheme}://{host}/{quote(name)}"


def _open(file: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(_uri(file))
    return system.open_input_file(name)


def _ends(raw: np.ndarray, after: int, inside: np.ndarray | None) -> np.ndarray:
    """Places of line ends in ``raw``: a feed, or a return that no feed follows
    (``after`` is the byte after ``raw``, or -1), not ``inside`` quotes."""
    end = raw == _FEED
    back = np.flatnonzero(raw == _RETURN)
    if len(back):
        follows = np.append(raw[1:].astype(np.int16), after)[back]
        end[back[follows != _FEED]] = True
    return np.flatnonzero(end if inside is None else end & ~inside)


def _inside(raw: np.ndarray, state: int) -> np.ndarray:
    """Whether each byte stands inside quotes that were open (``state`` 1) or closed before."""
    return ((np.cumsum(raw == _QUOTE) + state) & 1).astype(bool)


def _finished(f, at: int, state: int | None) -> tuple[bytes, int]:
    """The bytes from ``at`` to the line end that closes a line, and whether there is one."""
    parts = []
    while True:
        f.seek(at)
        data = f.read(AHEAD + 1)
        own = np.frombuffer(data[:AHEAD], np.uint8)
        inside = None if state is None else _inside(own, state)
        ends = _ends(own, data[AHEAD] if len(data) > AHEAD else -1, inside)
        if len(ends):
            parts.append(data[: ends[0] + 1])
            return b"".join(parts), 1
        parts.append(data[:AHEAD])
        if len(data) <= AHEAD:
            return b"".join(parts), 0
        at += AHEAD
        state = None if state is None else int(inside[-1])


def _pieces(f, lo: int, hi: int, state: int | None) -> Iterator[tuple[int, bytes]]:
    """``(offset, line)`` of the lines that start in a range, without their
    ends; with a quote ``state`` (at ``lo``), of its records."""
    base = max(lo - 1, 0)
    f.seek(base)
    data = f.read(hi - base + 1)
    own = np.frombuffer(data, np.uint8)[: hi - base]
    inside = None
    if state is not None:
        inside = np.concatenate([np.full(lo - base, bool(state)), _inside(own[lo - base :], state)])
    ends = _ends(own, data[hi - base] if len(data) > hi - base else -1, inside)
    starts = ends + 1
    if lo == 0:
        starts = np.append(0, starts)
    starts = starts[(starts >= lo - base) & (starts < hi - base)]
    stops = np.searchsorted(ends, starts)
    for s, k in zip(starts.tolist(), stops.tolist(), strict=True):
        if k < len(ends):
            line, ended = data[s : ends[k] + 1], 1
        else:
            rest, ended = _finished(f, hi, None if state is None else int(inside[-1]))
            line = data[s : hi - base] + rest
        if ended:
            line = line[:-2] if line.endswith(b"\r\n") else line[:-1]
        yield base + s, line


def _rows(pieces: Iterator[tuple], names: Sequence[str], kinds: Sequence[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held = []
    for p in pieces:
        held.append(p)
        if len(held) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=list(names))


def read_line_offsets(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``(file, at, line)``: every line of the text files under ``path``, with
    its byte offset.  Lines end at a feed, a return, or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, lo, hi, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(file) as f:
                    found = ((file, at, line.decode(errors="replace")) for at, line in _pieces(f, lo, hi, None))
                    yield from _rows(found, ("file", "at", "line"), (pa.string(), pa.int64(), pa.string()))

    return byte_ranges(spark, path, size)[0].mapInArrow(run, "file string, at long, line string")


def _starting(raw: np.ndarray, after: int, lead: int, state: int, header: bool) -> int:
    """How many records that are not blank start in a range (its bytes without
    the ``lead`` ones before it), if it starts with the quote ``state``; a
    ``header`` (the record at offset 0) is none."""
    inside = np.concatenate([np.full(lead, bool(state)), _inside(raw[lead:], state)])
    ends = _ends(raw, after, inside)
    starts = ends + 1
    starts = starts[(starts >= lead) & (starts < len(raw))]
    if lead == 0 and not header:
        starts = np.append(0, starts)
    stops = np.append(ends, len(raw))[np.searchsorted(ends, starts)]
    one, two = stops == starts, (raw[starts] == _RETURN) & (stops == starts + 1)
    feeds = np.append(raw, np.uint8(max(after, 0)))[np.minimum(starts + 1, len(raw))] == _FEED
    return int(len(starts) - np.count_nonzero(one | two & feeds))


def _with_states(ranges: DataFrame) -> DataFrame:
    """Ranges with ``state``: 1 if they start inside quotes; and ``before``: how
    many records after the header, blank ones left out, start in the ranges
    before them.  Files of one range are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for file, lo, hi, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if hi == length:  # no range comes after it
                    told.append((0, 0, 0))
                    continue
                with _open(file) as f:
                    base = max(lo - 1, 0)
                    f.seek(base)
                    data = f.read(hi - base + 1)
                raw = np.frombuffer(data, np.uint8)
                own, after = raw[: hi - base], int(raw[hi - base])
                odd = int(np.count_nonzero(own[lo - base :] == _QUOTE) & 1)
                told.append((odd, *(_starting(own, after, lo - base, state, lo == 0) for state in (0, 1))))
            columns = [pa.array(c, pa.int64()) for c in zip(*told, strict=True)] if told else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *columns], names=["file", "lo", "hi", "odd", "n0", "n1"])

    before = Window.partitionBy("file").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    told = ranges.mapInArrow(run, "file string, lo long, hi long, odd long, n0 long, n1 long")
    told = told.withColumn("state", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
    n = F.when(F.col("state") == 0, F.col("n0")).otherwise(F.col("n1"))
    return told.select("file", "lo", "hi", "state", F.coalesce(F.sum(n).over(before), F.lit(0)).alias("before"))


def _csv_pieces(spark: SparkSession, path: str, size: int, schema: str, of_file: Callable, names: Sequence[str], kinds: Sequence[pa.DataType]) -> DataFrame:
    """Rows that ``of_file(file, open file)`` makes of each record ``(ordinal,
    offset, bytes)`` of its file; the records after the header are numbered from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for b in batches:
                for file, lo, hi, state, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    with _open(file) as f:
                        make = of_file(file, f)
                        for at, r in _pieces(f, lo, hi, state):
                            if r:
                                n += at > 0
                                yield make(n, at, r)

        yield from _rows(made(), names, kinds)  # the records of many small files share a batch

    ranges, tasks = byte_ranges(spark, path, size)
    return _with_states(ranges).repartition(tasks, "file", "lo").mapInArrow(run, schema)


def read_csv_records(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``(file, at, record)``: the text of every CSV record under ``path``,
    line ends inside quotes included, header records (``at`` 0) too; blank
    lines are none."""

    def of_file(file: str, f):
        return lambda n, at, r: (file, at, r.decode(errors="replace"))

    return _csv_pieces(spark, path, size, "file string, at long, record string", of_file, ("file", "at", "record"), (pa.string(), pa.int64(), pa.string()))


def read_csv_by_name(spark: SparkSession, path: str, columns: Sequence[str], renamed: Mapping[str, str], null: str, size: int = RANGE) -> DataFrame:
    """``(file, at, ordinal, <columns...>)`` as texts: the columns found by name in each
    file's own header, whatever their order; those that a file lacks are NULL.
    Every task reads the header of the file at hand, so no layout is assumed."""
    columns, renamed = list(columns), dict(renamed)

    def cells(record: bytes) -> list[str | None]:
        row = next(csv.reader(io.StringIO(record.decode(errors="replace"), newline=""), quoting=csv.QUOTE_NOTNULL), [])
        return [None if c == null else c for c in row]

    def of_file(file: str, f):
        csv.field_size_limit(1 << 30)
        first, _ = _finished(f, 0, 0)
        head = [c.strip() if c else c for c in cells(first.removeprefix(b"\xef\xbb\xbf").rstrip(b"\r\n"))]
        place = {name: head.index(name) for name in reversed(columns) if name in head}
        for other, meant in renamed.items():
            if meant in columns and meant not in place and other in head:
                place[meant] = head.index(other)
        at_of = [place.get(name, -1) for name in columns]

        def make(n: int, at: int, record: bytes) -> tuple:
            row = cells(record)
            return (file, at, n, *(row[i] if 0 <= i < len(row) else None for i in at_of))

        return make

    names = ["file", "at", "ordinal", *columns]
    schema = ", ".join(["file string", "at long", "ordinal long", *(f"`{c}` string" for c in columns)])
    return _csv_pieces(spark, path, size, schema, of_file, names, [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(columns)]).where("at > 0")
