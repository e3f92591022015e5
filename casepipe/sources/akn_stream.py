"""Judgment XML in one parse: header, body and elements as tagged rows.

``akn_rows`` reads every document once and gives what the main paragraphs,
the cover text and the segments need, told apart by ``kind``.  Written once
(``casepipe.session.checkpoint``), these rows feed all three tables.

A document is fed to the parser in pieces and its rows leave the task as its
elements end, so a task holds the open elements and the texts of open
paragraphs, not the tree.  A first pass without any handler tells whether the
document is well formed: a broken one gives a single row of kind ``error`` and
none of its earlier elements.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casepipe.functions.text import paragraph_ok
from casepipe.operators.segments import build_segments, concat_by
from casepipe.sources.akn import AKN_NS, YIELD_ROWS, _failure, _local

ROW_SCHEMA = (
    "file_name string, kind string, pos int, paragraph string, close_ev int, depth int, tag string, "
    "has_style boolean, text string, tail string, seg int, error string"
)
#: Bytes fed to the parser at a time.
PIECE = 1 << 16
#: Sections whose paragraphs are rows, by their element.
SECTIONS = {f"{{{AKN_NS}}}header": "header", f"{{{AKN_NS}}}judgmentBody": "body"}
P_TAG = f"{{{AKN_NS}}}p"

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_FIELDS = [tuple(f.split()) for f in ROW_SCHEMA.split(", ")]


class _Silent:
    """Target of the well-formedness pass: takes no event."""


class _Rows:
    """Parser target that turns the events of one document into rows.

    Text is handed on at the next tag: to the element that opened last, or as
    the tail of the one that closed last, and to every paragraph around it.
    """

    def __init__(self, path: str):
        self.path = path
        self.rows: list[tuple] = []
        self.pieces: list[str] = []
        self.elements: list[list] = []  # open ones: [event, tag, has_style, segment, text]
        self.closed: list | None = None  # the last one, until its tail is known
        self.sections: dict[str, int] = {}  # open sections: depth
        self.counts: dict[str, int] = {}  # sections seen so far: their paragraphs
        self.paragraphs: list[list] = []  # open ones: [kind, pos, depth, texts]
        self.ended: list[list] = []  # closed ones without their tail
        self.events = self.segment = 0

    def _text(self) -> None:
        s = "".join(self.pieces) if self.pieces else None
        self.pieces = []
        if self.closed is not None:
            event, close, depth, tag, style, seg, text = self.closed
            self.rows.append((self.path, "event", event, None, close, depth, tag, style, text, s, seg, None))
            self.closed = None
        elif self.elements:
            self.elements[-1][4] = s
        if s is not None:
            for p in self.paragraphs:
                p[3].append(s)
        for kind, pos, _, texts in self.ended:
            self.rows.append((self.path, kind, pos, "".join(texts) + (s or ""), *[None] * 8))
        self.ended = []

    def data(self, s: str) -> None:
        self.pieces.append(s)

    def start(self, tag: str, attributes: dict) -> None:
        self._text()
        depth, local, style = len(self.elements), _local(tag), "style" in attributes
        if tag == P_TAG:
            for kind in self.sections:
                self.paragraphs.append([kind, self.counts[kind], depth, []])
                self.counts[kind] += 1
        kind = SECTIONS.get(tag)
        if kind is not None and kind not in self.counts:  # only the first section of its kind
            self.sections[kind], self.counts[kind] = depth, 0
            self.rows.append((self.path, kind, -1, *[None] * 9))
        self.segment += local == "num" and style
        self.elements.append([self.events, local, style, self.segment, None])
        self.events += 1

    def end(self, _tag: str) -> None:
        self._text()
        event, local, style, seg, text = self.elements.pop()
        depth = len(self.elements)
        self.closed = [event, self.events - 1, depth, local, style, seg, text]
        while self.paragraphs and self.paragraphs[-1][2] == depth:
            self.ended.append(self.paragraphs.pop())
        self.sections = {k: at for k, at in self.sections.items() if at != depth}

    def close(self) -> None:
        self._text()


def _feed(content: bytes, target) -> Iterator[None]:
    parser = ET.XMLParser(target=target)
    for i in range(0, len(content), PIECE):
        parser.feed(content[i : i + PIECE])
        yield
    parser.close()
    yield


def _document(path: str, content: bytes | None) -> Iterator[list[tuple]]:
    """The rows of one document, some at a time."""
    try:
        for _ in _feed(content, _Silent()):
            pass
    except Exception as e:  # noqa: BLE001 - one document must not fail the job
        yield [(path, "error", *[None] * 9, _failure(e))]
        return
    target = _Rows(path)
    for _ in _feed(content, target):
        if target.rows:
            yield target.rows
            target.rows = []


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])

    rows: list[tuple] = []
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            for part in _document(path.as_py(), content.as_py()):
                rows += part
                if len(rows) >= YIELD_ROWS:
                    yield batch(rows)
                    rows = []
    if rows:
        yield batch(rows)


def akn_rows(scan: DataFrame) -> DataFrame:
    """Rows of all documents of ``scan (path, content)``, each parsed once.

    ``kind`` is ``header`` or ``body`` for the paragraphs of the first such
    section (``pos`` in document order; -1 without text: the section is there),
    ``event`` for elements (``pos`` in pre-order) and ``error`` for documents
    that cannot be parsed, or that have no content.
    """
    return scan.select("path", "content").mapInArrow(_run, ROW_SCHEMA)


def main_paragraphs(rows: DataFrame) -> DataFrame:
    """``(file_name, pos, paragraph)``: body texts after the main quality filter."""
    body = (F.col("kind") == "body") & (F.col("pos") >= 0)
    return rows.where(body & paragraph_ok("paragraph")).select("file_name", "pos", "paragraph")


def covers(rows: DataFrame) -> DataFrame:
    """``(file_name, cover_text)`` of every file with a header."""
    kept = rows.where(F.col("kind") == "header").select(
        "file_name", "pos", F.when(paragraph_ok("paragraph", need_alnum=False), F.col("paragraph")).alias("v")
    )
    return concat_by(kept, "file_name", "pos", "v", "", out="cover_text", keep_empty_groups=True).select("file_name", "cover_text")


def events(rows: DataFrame) -> DataFrame:
    """One row per element, as ``akn.akn_events`` gives them."""
    return rows.where(F.col("kind") == "event").select(
        "file_name", F.col("pos").alias("ev"), "close_ev", "depth", "tag", "has_style", "text", "tail", "seg"
    )


def case_tables(rows: DataFrame) -> DataFrame:
    """The three tables of every document side by side, one row per file.

    ``(file_name, error_kind, cover_text, n_paragraphs, paragraph_chars,
    n_segments, segment_chars)``; counts are 0 and ``cover_text`` NULL where a
    file has none.  Hand over stored rows: each table reads them.
    """
    files = rows.groupBy("file_name").agg(F.max(F.substring_index("error", ":", 1)).alias("error_kind"))
    paragraphs = main_paragraphs(rows).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_paragraphs"), F.sum(F.length("paragraph")).cast("long").alias("paragraph_chars")
    )
    segments = build_segments(events(rows)).groupBy("file_name").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.length("segment")).cast("long").alias("segment_chars")
    )
    joined = files
    for part in (covers(rows), paragraphs, segments):
        joined = joined.join(part, "file_name", "left")
    return joined.fillna(0, ["n_paragraphs", "paragraph_chars", "n_segments", "segment_chars"])
