"""IOB (CoNLL-style) token files.

Lines are read in byte ranges and named by their byte offset, so a file of any
size is read by many tasks; documents are then cut at ``-DOCSTART-`` lines
inside blocks of lines, and the blocks' edges are stitched together.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from casepipe.session import checkpoint, shuffles_dropped

from casepipe.functions.tags import tag_id
from casepipe.functions.text import strip_ws
from casepipe.operators.segments import BLOCK_ROWS, earlier_max
from casepipe.sources.ranges import RANGE, read_line_offsets

# --- fixed values: must equal the reference's for identical results -------
DOCSTART_TRAINER = "-DOCSTART- -X-"
DOCSTART_EDA = "-DOCSTART-"
# ---------------------------------------------------------------------------


def read_lines(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``(file, line_no, line)`` of text files at any depth, read in byte
    ranges; ``line_no`` is the byte offset of the line in its file: increasing,
    and the same in every run of a task."""
    return read_line_offsets(spark, path, size).withColumnRenamed("at", "line_no")


def dense_ids(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out`` = 0, 1, ... in ``order``: sorted ranges number
    their own rows, and the ranges' sizes (one row each) are summed up."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = checkpoint(ranged).withColumn("_part", F.shiftright("_m", 33))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(sizes, "_part").withColumn(out, F.col("_before") + inside).drop("_m", "_part", "_before")


#: Tag of a ``-DOCSTART-`` line in packed lines.
START = -1


def _blob(numbers: list[np.ndarray], text: str) -> bytes:
    """Arrays of one length (or none) and a text, compressed."""
    raw = b"".join([(len(numbers[0]) if numbers else 0).to_bytes(4, "little"), *(x.tobytes() for x in numbers), text.encode("utf-8", "surrogatepass")])
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _from_blob(blob: bytes, *kinds: type) -> tuple:
    raw = pa.decompress(blob[4:], int.from_bytes(blob[:4], "little"), codec="zstd", asbytes=True)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += out[-1].nbytes
    return *out, raw[at:].decode("utf-8", "surrogatepass")


def _words(texts: list[str]) -> pa.Array:
    """The words of texts that tabs part."""
    return pc.split_pattern(pa.array(["\t".join(texts)], pa.large_string()), "\t").values.cast(pa.string())


def _joined(words: pa.Array, ends: np.ndarray) -> list[str]:
    """The words between ``ends`` as texts, parted by tabs."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), "\t").to_pylist()


def _packed(block: int) -> Callable:
    """Rows ``(file, at, token, tag)`` as one row ``(file, block, blob)`` for the lines
    of a block of a file in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            file, at, token, tag = b.columns
            at = at.to_numpy(zero_copy_only=False)
            code = pc.dictionary_encode(file).indices.to_numpy(zero_copy_only=False)
            if (np.diff(code) < 0).any() or ((np.diff(code) == 0) & (np.diff(at) < 0)).any():
                by = np.lexsort((at, code))
                file, token, tag = (c.take(pa.array(by)) for c in (file, token, tag))
                at, code = at[by], code[by]
            blk = at // block
            first = np.flatnonzero(np.append(True, (np.diff(code) != 0) | (np.diff(blk) != 0)))
            ends = np.append(first, len(at))
            offset, tag = (at - blk * block).astype(np.int32), tag.to_numpy(zero_copy_only=False).astype(np.int8)
            step = np.diff(offset, prepend=np.int32(0))
            step[first] = offset[first]
            blobs = [_blob([step[i:j], tag[i:j]], t) for i, j, t in zip(ends, ends[1:], _joined(token, ends), strict=False)]
            yield pa.RecordBatch.from_arrays([file.take(pa.array(first)), pa.array(blk[first], pa.int64()), pa.array(blobs, pa.binary())], names=[b.schema.names[0], "_blk", "_x"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(file, block, blobs)`` as one row ``(file, block, starts, k, tokens, blob)``
    for each run of tokens between the block's starts: ``k`` starts of the block stand
    before it.  A block without tokens is one row without a blob."""
    for b in batches:
        rows = []
        for file, blk, blobs in zip(*b.columns, strict=True):
            steps, tags, texts = zip(*(_from_blob(x.as_py(), np.int32, np.int8) for x in blobs), strict=True)
            at, tag, words = np.concatenate([np.cumsum(x) for x in steps]), np.concatenate(tags), _words(texts)
            if (np.diff(at) <= 0).any():  # lines on one number: tokens in order of their own, then starts
                t = pa.table([pa.array(at), pa.array(tag == START), words, pa.array(tag)], names=["at", "start", "word", "tag"])
                by = pc.sort_indices(t, [(c, "ascending") for c in t.column_names])
                words, tag = words.take(by), tag[by.to_numpy()]
            token = tag != START
            k, starts = np.cumsum(~token)[token], int(np.count_nonzero(~token))
            words, tag = words.filter(pa.array(token)), tag[token]
            if not len(tag):
                rows.append((file.as_py(), blk.as_py(), starts, 0, 0, None))
                continue
            first = np.flatnonzero(np.append(True, np.diff(k) != 0))
            ends = np.append(first, len(k))
            for i, j, t in zip(ends, ends[1:], _joined(words, ends), strict=False):
                rows.append((file.as_py(), blk.as_py(), starts, int(k[i]), int(j - i), _blob([tag[i:j]], t)))
        if rows:
            kinds = [b.schema.types[0], pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[b.schema.names[0], "_blk", "_starts", "_k", "_n", "_x"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(part, line_no, line)`` as one row ``(part, first, last line_no, blob)`` for each
    run of lines of a batch that follow each other."""
    for b in batches:
        part, at, line = b.columns
        at = at.to_numpy(zero_copy_only=False)
        new = np.append(True, (np.diff(at) != 1) | pc.not_equal(part[1:], part[:-1]).to_numpy(zero_copy_only=False))
        first = np.flatnonzero(new[: len(at)])
        ends = np.append(first, len(at))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), line), "\n").to_pylist()
        blobs = [_blob([], t) for t in texts]
        yield pa.RecordBatch.from_arrays([part.take(pa.array(first)), pa.array(at[first]), pa.array(at[ends[1:] - 1]), pa.array(blobs, pa.binary())], names=["part", "_first", "_last", "_x"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by part and first line, as ``(part, text)`` of one or more lines in order.
    Runs that overlap are taken apart and sorted by line."""

    def made() -> Iterator[tuple[str, str]]:
        group, part, last = [], None, None

        def text() -> str:
            read = [(lo, _from_blob(x)[0]) for lo, x in group]
            if len(read) == 1:
                return read[0][1]
            lines = sorted(((lo + i, t) for lo, x in read for i, t in enumerate(x.split("\n"))), key=lambda x: x[0])
            return "\n".join(t for _, t in lines)

        for b in batches:
            for p, lo, hi, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and (p != part or lo > last):
                    yield part, text()
                    group, last = [], None
                group.append((lo, x))
                part, last = p, hi if last is None else max(last, hi)
        if group:
            yield part, text()

    rows = made()
    while held := list(itertools.islice(rows, 500)):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["part", "line"])


def write_lines(lines: DataFrame, root: str) -> None:
    """``(part, line_no, line)`` as text files, one under ``part=<part>`` for each part, its
    lines in order, those without a number first.  Lines travel in compressed runs; a
    line holds no line end."""
    at = F.coalesce(F.col("line_no").cast("long"), F.lit(-(1 << 63)))
    s = lines.select(F.coalesce("part", F.lit("")).alias("part"), at.alias("line_no"), F.coalesce("line", F.lit("")).alias("line"))
    runs = s.mapInArrow(_runs, "part string, _first long, _last long, _x binary")
    texts = runs.repartition("part").sortWithinPartitions("part", "_first").mapInArrow(_texts, "part string, line string")
    with shuffles_dropped(lines.sparkSession):
        texts.write.partitionBy("part").text(root)


#: Bytes of compressed tokens that become rows at once, about.
_UNPACKED = 4 << 20


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, file, blobs in order)`` as ``(id, tokens, ner_tags, file)``."""
    for b in batches:
        name, (ids, files, blobs) = b.schema.names[1], b.columns
        sizes = np.cumsum([sum(len(x) for x in row) for row in blobs.to_pylist()])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // _UNPACKED)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            parts = [[_from_blob(x, np.int8) for x in row] for row in blobs[i:j].to_pylist()]
            ends = pa.array(np.append(0, np.cumsum([sum(len(p[0]) for p in row) for row in parts])), pa.int32())
            words = _words([p[1] for row in parts for p in row])
            tags = pa.array(np.concatenate([p[0] for row in parts for p in row]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids[i:j], pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, tags), files[i:j]], names=["id", "tokens", "ner_tags", name])


def iob_documents(lines: DataFrame, file_col: str = "file", order: str = "line_no", materialize: bool = False, block: int = BLOCK_ROWS) -> DataFrame:
    """Trainer reader: documents ``(id, tokens, ner_tags)``.

    Each line is stripped; a line starting ``-DOCSTART- -X-`` ends the current
    document; blank lines are not boundaries; other lines split on TAB, token
    = first field, tag = last field, unknown tag -> 0.  Empty documents take
    no id; ids are ``'0', '1', ...`` in file order.  ``line_no`` is any whole number
    that increases along a file: the line's number, or its byte offset.

    Lines travel as compressed runs, not as rows.  They meet by ``block`` numbers of
    their file, where each run of tokens between two starts becomes one row; a run
    that opens a block belongs to the last start of an earlier block, which a
    table of one row per block tells.  With ``materialize`` the runs are
    checkpointed once (eager, shared checkpoint folder), because the id
    numbering reads them too, and the shuffles that led to them are dropped.
    """
    spark = lines.sparkSession
    s = lines.select(file_col, F.col(order).cast("long").alias("_at"), strip_ws(F.col("line")).alias("_l"))
    s = s.where((F.col("_l") != "") & F.col(file_col).isNotNull() & F.col("_at").isNotNull())
    start = F.col("_l").startswith(DOCSTART_TRAINER)
    token = F.when(start, F.lit("")).otherwise(F.substring_index("_l", "\t", 1))
    tag = F.when(start, F.lit(START)).otherwise(tag_id(F.substring_index("_l", "\t", -1)))
    kind = dict(s.dtypes)[file_col]
    packed = s.select(file_col, "_at", token.alias("_token"), tag.cast("int").alias("_tag"))
    packed = packed.mapInArrow(_packed(block), f"`{file_col}` {kind}, _blk long, _x binary")
    pieces = packed.groupBy(file_col, "_blk").agg(F.collect_list("_x").alias("_x"))
    pieces = pieces.mapInArrow(_cut, f"`{file_col}` {kind}, _blk long, _starts long, _k long, _n long, _x binary")
    if materialize:
        with shuffles_dropped(spark):
            pieces = checkpoint(pieces.select("*"))  # the setting counts where a frame is made
    # a document is named by its start: the block, and the starts in it up to this one
    named = lambda k: F.col("_blk") * F.lit(1 << 31) + F.col(k)
    blocks = pieces.groupBy(file_col, "_blk").agg(F.max("_starts").alias("_starts"))
    blocks = earlier_max(blocks.withColumn("_doc", F.when(F.col("_starts") > 0, named("_starts"))), file_col, "_blk", ["_doc"])
    opened = blocks.select(file_col, "_blk", F.coalesce("before__doc", F.lit(-(1 << 63))).alias("_doc"))
    some = pieces.where("_n > 0")

    def with_names(cols: list[str]) -> DataFrame:
        inner = some.where("_k > 0").select(file_col, named("_k").alias("_doc"), *cols)
        return inner.unionByName(some.where("_k = 0").select(file_col, "_blk", *cols[1:]).join(opened.hint("shuffle_hash"), [file_col, "_blk"]).select(file_col, "_doc", *cols))

    # dense ids in (file, document) order, from the slim table of names
    ids = dense_ids(with_names(["_blk"]).select(file_col, "_doc").distinct(), [file_col, "_doc"], "_id")
    # merged on what the grouping below needs, so the pieces are dealt out once
    docs = with_names(["_blk", "_x"]).hint("merge").join(ids, [file_col, "_doc"]).groupBy(file_col, "_doc").agg(
        F.first("_id").alias("_id"), F.array_sort(F.collect_list(F.struct("_blk", "_x"))).alias("_x")
    )
    docs = docs.select(F.col("_id").cast("string").alias("id"), file_col, F.transform("_x", lambda x: x["_x"]).alias("_x"))
    return docs.mapInArrow(_unpacked, f"id string, tokens array<string>, ner_tags array<int>, `{file_col}` {kind}")


def iob_tokens(lines: DataFrame, file_col: str = "file", order: str = "line_no") -> DataFrame:
    """EDA reader: ``(file, line_no, word, tag)`` for lines not starting with
    ``-DOCSTART-`` that have exactly two whitespace-separated fields."""
    s = lines.where(~F.col("line").startswith(DOCSTART_EDA))
    parts = F.split(strip_ws(F.col("line")), r"(?U)\s+", -1)
    ok = (F.size(parts) == 2) & (strip_ws(F.col("line")) != "")
    return s.where(ok).select(file_col, order, F.get(parts, 0).alias("word"), F.get(parts, 1).alias("tag"))
