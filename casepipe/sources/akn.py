"""Akoma Ntoso judgment XML.

Spark's XML reader and ``xpath`` lose mixed-content order, so each document
is parsed by the standard-library ElementTree inside ``mapInPandas`` (Arrow
batches, one Python worker per task, no driver collect).  The parser only
*emits rows* -- paragraph texts with their position, or one event per
element in pre-order; filtering, ordering, grouping and concatenation are
Spark operators on those rows (``casepipe.operators.segments``).

Input: ``(path, content BINARY)`` -- a ``binaryFile`` scan of
``root/*/*.xml`` or any DataFrame with those columns.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.functions.text import paragraph_ok
from casepipe.operators.segments import concat_by
from casepipe.sources.ranges import list_files

# --- fixed values: must equal the reference's for identical results -------
AKN_NS = "http://docs.oasis-open.org/legaldocml/ns/akn/3.0"
# ---------------------------------------------------------------------------

PARA_SCHEMA = "file_name STRING, pos INT, paragraph STRING, error STRING"
EVENT_SCHEMA = (
    "file_name STRING, ev INT, close_ev INT, depth INT, tag STRING, has_style BOOLEAN, text STRING, tail STRING, seg INT, error STRING"
)
#: Rows that a task holds before it hands them on.
YIELD_ROWS = 5000


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """XML files in the immediate sub-folders of ``root`` (``root/*/*.xml``)."""
    return spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.xml").select(
        F.col("path").alias("path"), F.col("content")
    )


def scan_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size)`` of the same files, without reading their contents: tasks list the sub-folders."""
    files = list_files(spark, root, depth=2).where(F.col("file").endswith(".xml"))
    return files.select(F.col("file").alias("path"), F.col("length").alias("size"))


def _failure(e: Exception) -> str:
    """``kind: message`` of anything that can go wrong with one document."""
    kind = "parse" if isinstance(e, ET.ParseError) else "encoding" if isinstance(e, (LookupError, UnicodeError)) else type(e).__name__
    return f"{kind}: {e}"


def _chunks(documents: Iterator[list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of documents as frames of about ``YIELD_ROWS`` rows."""
    rows: list[tuple] = []
    for own in documents:
        rows += own
        if len(rows) >= YIELD_ROWS:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _local(tag: str) -> str:
    """Local name of an element of the judgment namespace; other elements keep
    their qualified name, so they are never taken for one of ours."""
    own = f"{{{AKN_NS}}}"
    return tag.removeprefix(own) if isinstance(tag, str) else ""


def _paragraph_rows(section: str):
    sec_tag = f"{{{AKN_NS}}}{section}"
    p_tag = f"{{{AKN_NS}}}p"

    def of(path: str, content: bytes) -> list[tuple]:
        try:
            root = ET.fromstring(bytes(content))
            sec = root if root.tag == sec_tag else root.find(f".//{sec_tag}")
            if sec is None:
                return []
            rows: list[tuple] = [(path, -1, None, None)]  # marker: the section exists
            for i, p in enumerate(sec.iterfind(f".//{p_tag}")):
                rows.append((path, i, "".join(p.itertext()) + (p.tail or ""), None))
            return rows
        except Exception as e:  # noqa: BLE001 - one document must not fail the job
            return [(path, None, None, _failure(e))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        documents = (of(path, content) for b in batches for path, content in zip(b["path"], b["content"]))
        yield from _chunks(documents, ["file_name", "pos", "paragraph", "error"])

    return run


def akn_paragraph_texts(scan: DataFrame, section: str = "judgmentBody", markers: bool = False) -> DataFrame:
    """Raw ``p`` texts under the first ``section`` element, document order,
    nested ``p`` included; a row with ``error`` set for unparsable files.
    With ``markers`` each file whose section exists also has a row with
    ``pos = -1`` and a NULL paragraph (so an empty section is visible)."""
    raw = scan.select("path", "content").mapInPandas(_paragraph_rows(section), PARA_SCHEMA)
    return raw if markers else raw.where(F.col("pos").isNull() | (F.col("pos") >= 0))


def akn_paragraphs(scan: DataFrame, section: str = "judgmentBody") -> DataFrame:
    """Main paragraphs ``(file_name, pos, paragraph)``: body texts after the
    main quality filter."""
    raw = akn_paragraph_texts(scan, section)
    return raw.where(F.col("error").isNull() & paragraph_ok("paragraph")).select("file_name", "pos", "paragraph")


def akn_cover(scan: DataFrame) -> DataFrame:
    """Cover text per file with a ``header``: header ``p`` texts after the
    cover filter, joined with ``''``; files without a header give no row,
    files whose header has no surviving paragraph give ``''``.  One parse,
    one ordered concat."""
    raw = akn_paragraph_texts(scan, "header", markers=True).where(F.col("error").isNull())
    kept = raw.select("file_name", "pos", F.when(paragraph_ok("paragraph", need_alnum=False), F.col("paragraph")).alias("v"))
    return concat_by(kept, "file_name", "pos", "v", "", out="cover_text", keep_empty_groups=True).select("file_name", "cover_text")


def _events_of(path: str, content: bytes) -> list[tuple]:
    """Events of one document, by an iterative walk: any depth of nesting."""
    try:
        root = ET.fromstring(bytes(content))
        rows: list[list] = []
        seg = 0
        stack: list[tuple[ET.Element | None, int]] = [(root, 0)]
        while stack:
            el, at = stack.pop()
            if el is None:  # the element of row ``at`` ends: its last descendant is the last row so far
                rows[at][2] = len(rows) - 1
                continue
            tag, style = _local(el.tag), "style" in el.attrib
            seg += tag == "num" and style
            stack.append((None, len(rows)))
            rows.append([path, len(rows), None, at, tag, style, el.text, el.tail, seg, None])
            stack.extend((child, at + 1) for child in reversed(el))
        return [tuple(r) for r in rows]
    except Exception as e:  # noqa: BLE001 - one document must not fail the job
        return [(path, None, None, None, None, None, None, None, None, _failure(e))]


def _event_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    yield from _chunks((_events_of(path, content) for b in batches for path, content in zip(b["path"], b["content"])), columns)


def akn_events(scan: DataFrame) -> DataFrame:
    """One row per element in pre-order: ``(file_name, ev, close_ev, depth,
    tag, has_style, text, tail, seg)``; ``close_ev`` is the pre-order number of
    the element's last descendant (for document-order segments), ``seg`` the
    number of styled ``num`` elements so far."""
    return scan.select("path", "content").mapInPandas(_event_rows, EVENT_SCHEMA)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Files that failed to parse ``(file_name, error)``."""
    return parsed.where(F.col("error").isNotNull()).select("file_name", "error").distinct()


def error_report(parsed: DataFrame) -> DataFrame:
    """``(error_kind, n_files)``: files per failure kind (text before ``:``)."""
    q = quarantine(parsed)
    return q.groupBy(F.substring_index(F.col("error"), ":", 1).alias("error_kind")).agg(
        F.count_distinct("file_name").alias("n_files")
    )
