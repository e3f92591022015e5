"""Sinks: JSON / CSV / Parquet writes, per-case annotation export and
metric rows.  Table writes go through Spark's commit protocol (atomic per
job); ``write_documents`` and ``write_grouped_csv`` write many single files, idempotently."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casepipe.functions.text import case_name, page_number
from casepipe.sources.ranges import list_files


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


#: What stands for NULL in CSV files (a private-use character: no text holds it).
CSV_NULL = "\ue000"
#: Options that make CSV lossless: every field quoted, quotes doubled, blanks
#: at either end kept, and NULL told from the empty text.
CSV_OPTIONS = {
    "header": "true",
    "quoteAll": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "nullValue": CSV_NULL,
    "emptyValue": "",
}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header that ``read_table_csv`` reads back verbatim: commas,
    quotes, newlines, blanks at the ends, empty texts and NULL."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_one_csv(df: DataFrame, path: str) -> None:
    """The same as ``write_csv``, in one file: tasks make its parts, and one task
    copies their bytes one after the other into the file."""
    spark = df.sparkSession
    job = uuid.uuid4().hex
    folder, system, target_root = _file_root(df, path)
    system.delete(folder, True)
    parts = f"{path.rstrip('/')}/_parts_{job}"
    df.write.options(**{**CSV_OPTIONS, "header": "false"}).csv(parts)
    header = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns) + "\n"

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        names = sorted(n for b in batches for n in b.column(0).to_pylist())
        filesystem, base = pafs.FileSystem.from_uri(target_root)
        with filesystem.open_output_stream(f"{base.rstrip('/')}/part-{job}.csv") as out:
            out.write(header.encode())
            for name in names:
                with filesystem.open_input_stream(f"{base.rstrip('/')}/_parts_{job}/{name}") as part:
                    while data := part.read(8 << 20):
                        out.write(data)
        yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    names = list_files(spark, parts).select(F.element_at(F.split("file", "/"), -1).alias("name"))
    names.repartition(1).mapInArrow(run, "n long").collect()
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(parts), True)


def _folder(value: str | None) -> str:
    """The name of a value in a partition folder, as Spark writes it."""
    if not value:
        return "__HIVE_DEFAULT_PARTITION__"
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\x7f\"#%'*/:=?\\{[]^" else c for c in value)


def folder_value(path: Column, name: str) -> Column:
    """The value of the partition folder ``<name>=<value>`` in a file's path."""
    text = F.regexp_extract(path, f"/{name}=([^/]*)/", 1)
    value = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text != "__HIVE_DEFAULT_PARTITION__", value)


def _file_root(df: DataFrame, root: str) -> tuple:
    """Hadoop's path and file system of ``root``, and its name for ``pyarrow.fs``."""
    # the same meaning that spark.read gives the path: the default file system's, if it names none
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(conf)
    target = system.makeQualified(path).toString()
    return path, system, "file://" + target[5:] if target.startswith("file:/") and not target.startswith("file://") else target


def write_grouped_csv(df: DataFrame, root: str, folders: Sequence[str], order: Sequence[str], mode: str = "overwrite") -> None:
    """One CSV file per value of the columns ``folders`` under
    ``<folder>=<value>/...``, as ``partitionBy`` lays them out, with rows in ``order``.

    Spark's file commit costs a few file operations per file on one machine, the
    driver.  Here the tasks write their files one after the other, line by
    line, into a hidden folder beside ``root``, which the driver then renames as
    a whole: all or nothing shows, and a retried task writes its files anew.
    Only what is appended to a ``root`` that exists is moved folder by folder.
    """
    folders = list(folders)
    path, system, _ = _file_root(df, root)
    if system.exists(path):
        if mode == "ignore":
            return
        if mode in ("error", "errorifexists", "default"):
            raise AnalysisException(f"path {root} already exists")
        if mode == "overwrite":
            system.delete(path, True)
    job = uuid.uuid4().hex
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    added = system.exists(path)
    temporary = hadoop(path if added else system.makeQualified(path).getParent(), f"_temporary_{job}")
    target_root = _file_root(df, temporary.toString())[2]
    cells = [c for c in df.columns if c not in folders]
    header = ",".join('"' + c.replace('"', '""') + '"' for c in cells) + "\n"
    options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"}
    lines = df.repartition(*folders).sortWithinPartitions(*folders, *order)
    lines = lines.select(*[F.col(f).cast("string") for f in folders], F.to_csv(F.struct(*cells), options).alias("_line"))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(target_root)
        last, out, n = None, None, 0
        try:
            for b in batches:
                *names, texts = (c.to_pylist() for c in b.columns)
                for case, line in zip(zip(*names, strict=True), texts, strict=True):
                    if case != last:
                        if out is not None:
                            out.close()
                        folder = "/".join([base, *(f"{f}={_folder(v)}" for f, v in zip(folders, case, strict=True))])
                        filesystem.create_dir(folder, recursive=True)
                        out = filesystem.open_output_stream(f"{folder}/part-{job}.csv", buffer_size=1 << 16)
                        out.write(header.encode())
                        last, n = case, n + 1
                    out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def move(source, target) -> None:
        for s in system.listStatus(source):
            to = hadoop(target, s.getPath().getName())
            if s.isDirectory() and system.exists(to):
                move(s.getPath(), to)  # appended to a folder that was there
            elif not system.rename(s.getPath(), to):
                raise OSError(f"could not move {s.getPath()} to {to}")

    system.mkdirs(temporary)
    try:
        lines.mapInArrow(run, "n long").agg(F.sum("n")).collect()
        if added:
            move(temporary, path)
        else:
            system.create(hadoop(temporary, "_SUCCESS"), True).close()
            if not system.rename(temporary, path):
                raise OSError(f"could not move {temporary} to {path}")
    finally:
        system.delete(temporary, True)
    if added:
        system.create(hadoop(path, "_SUCCESS"), True).close()


def export_cases(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One CSV folder per case under ``page=<n>/case=<name>``.

    Rows are clustered by (page, case) and sorted by ``pos`` inside each
    task, so every case is written by one task in paragraph order without a
    global sort.
    """
    out = df.withColumn("page", page_number("file_name")).withColumn("case", case_name("file_name"))
    write_grouped_csv(out, root, ["page", "case"], ["pos"], mode)


def write_metrics(df: DataFrame, path: str, method: str, mode: str = "overwrite") -> None:
    """A metric row (one-row frames only) with its ``method`` column, as one CSV file."""
    df.withColumn("method", F.lit(method)).coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_documents(df: DataFrame, root: str, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Write one file per row: ``content`` (BINARY) to ``root/<path>``.

    The corpus layout of downloaded judgments (``xml_page_N/<title>.xml``).
    Spark has no one-file-per-row writer, so each task writes its rows
    through ``pyarrow.fs`` (local, HDFS or S3 URIs alike).  Rewriting a path
    is idempotent, so a retried task after executor loss is harmless.
    Returns ``(path, n_bytes)`` lazily; run an action to write.
    """
    import pandas as pd

    target_root = _file_root(df, root)[2]

    def run(batches):
        from pyarrow import fs as pafs

        filesystem, base = pafs.FileSystem.from_uri(target_root)
        made: set[str] = set()
        for b in batches:
            sizes = []
            for rel, content in zip(b[path_col], b[content_col]):
                target = f"{base.rstrip('/')}/{rel.lstrip('/')}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                data = bytes(content)
                with filesystem.open_output_stream(target) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": b[path_col].astype(object), "n_bytes": pd.Series(sizes, dtype="int64")})

    return df.select(F.col(path_col), F.col(content_col)).mapInPandas(run, "path STRING, n_bytes BIGINT")
