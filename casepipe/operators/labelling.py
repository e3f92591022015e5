"""Batch labelling with a pluggable model function, and crash-safe resume.

``batch_label`` calls ``fn(list[str]) -> list[str | None]`` on batches of
``batch_size`` rows inside ``mapInPandas``: Spark partitions the rows, each
task streams Arrow batches through the function, and the number of
partitions bounds concurrency against a rate-limited service.  A failing
batch yields NULL outputs plus an ``error`` text instead of failing the job.
``pending`` + append-mode writes make the job resumable: a re-run labels
only rows without an output yet.  ``label_in_chunks`` commits bounded chunks
one by one, so a job that is killed keeps all that it had finished.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casepipe.functions.text import FACT_PATTERN

Labeller = Callable[[list[str]], list[str | None]]

_FACT_RE = re.compile(FACT_PATTERN.removeprefix("(?U)"))  # Python's own classes are Unicode ones
#: Rows of a chunk of ``label_in_chunks``, about; tasks that label one chunk.
CHUNK_ROWS = 100_000
CHUNK_TASKS = 8


def rule_labeller(texts: list[str]) -> list[str | None]:
    """Deterministic stand-in for a model: ``'1'`` when the text cites a
    statutory provision, else ``'0'`` (``None`` for a missing text)."""
    return [None if t is None else ("1" if _FACT_RE.search(t) else "0") for t in texts]


def prompt_labeller(head: str, tail: str) -> Labeller:
    """Labeller of rendered prompts: the stand-in rule on the text between ``head`` and ``tail``."""

    def fn(prompts: list[str]) -> list[str | None]:
        return rule_labeller([None if p is None else p.removeprefix(head).removesuffix(tail) for p in prompts])

    return fn


def failing_on(word: str, fn: Labeller) -> Labeller:
    """``fn``, but a batch with ``word`` in a text fails (a service's outage, for tests of resuming)."""

    def failing(texts: list[str]) -> list[str | None]:
        if any(word in (t or "") for t in texts):
            raise RuntimeError("service failed")
        return fn(texts)

    return failing


class Killed(BaseException):
    """What no labeller's error is: it ends the task, as a lost executor does."""


def killed_on(word: str, fn: Labeller) -> Labeller:
    """``fn``, but a text with ``word`` kills its task (for tests of crashes)."""

    def dying(texts: list[str]) -> list[str | None]:
        if any(word in (t or "") for t in texts):
            raise Killed(word)
        return fn(texts)

    return dying


def retrying(fn: Labeller, tries: int = 4, wait: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Labeller:
    """``fn``, called up to ``tries`` times a batch with a pause that doubles
    from ``wait`` seconds; the last failure is the batch's error."""

    def patient(texts: list[str]) -> list[str | None]:
        for n in range(tries - 1):
            try:
                return fn(texts)
            except Exception:  # noqa: BLE001 - whatever a service raises
                sleep(wait * 2**n)
        return fn(texts)

    return patient


def batch_label(
    df: DataFrame,
    text_col: str,
    keys: Sequence[str],
    fn: Labeller = rule_labeller,
    batch_size: int = 25,
    partitions: int | None = None,
) -> DataFrame:
    """``(keys..., output, error)`` for every row of ``df``.

    A task has one call under way at a time, so ``partitions`` bounds the
    calls at one time; ``retrying`` adds patience with a busy service.
    """
    keys = list(keys)
    src = df.select(*keys, F.col(text_col).alias("_text"))
    if partitions:
        src = src.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outs: list[str | None] = []
            errs: list[str | None] = []
            texts = b["_text"].tolist()
            for i in range(0, len(texts), batch_size):
                chunk = texts[i : i + batch_size]
                try:
                    res = list(fn(chunk))
                    if len(res) != len(chunk):
                        raise ValueError(f"labeller returned {len(res)} outputs for {len(chunk)} inputs")
                    outs.extend(res)
                    errs.extend([None] * len(chunk))
                except Exception as e:  # noqa: BLE001 - one bad batch must not fail the job
                    outs.extend([None] * len(chunk))
                    errs.extend([f"{type(e).__name__}: {e}"] * len(chunk))
            out = b[keys].copy()
            out["output"] = outs
            out["error"] = errs
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keys)
    return src.mapInPandas(run, f"{schema}, output STRING, error STRING")


def pending(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``todo`` without a result in ``done`` yet (left anti join);
    results with an ``error`` do not count, so failed rows are tried again."""
    if "error" in done.columns:
        done = done.where(F.col("error").isNull())
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def label_incremental(todo: DataFrame, out_path: str, text_col: str, keys: Sequence[str], fn: Labeller = rule_labeller, batch_size: int = 25) -> DataFrame:
    """Label what is not yet in ``out_path`` (Parquet) and append it.

    Idempotent: a re-run after a crash labels only the rows still pending;
    each run's output lands atomically through Spark's commit protocol.
    """
    spark = todo.sparkSession
    try:
        todo = pending(todo, spark.read.parquet(out_path), keys)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise  # only a first run has nothing to resume from
    batch_label(todo, text_col, keys, fn, batch_size).write.mode("append").parquet(out_path)
    return latest_outputs(spark.read.parquet(out_path), keys)


def latest_outputs(outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: its answer, or the error if no run has answered it."""
    answered = F.struct(F.col("error").isNull(), F.col("output"), F.col("error"))
    best = outputs.groupBy(*keys).agg(F.max_by(F.struct("output", "error"), answered).alias("_r"))
    return best.select(*keys, "_r.output", "_r.error")


class CommitLog:
    """Folders of a chunked run below ``root``.

    ``round=<r>/todo`` holds the rows of a round, dealt to chunks once;
    ``round=<r>/out/chunk=<c>`` a chunk's answers, overwritten when the chunk
    is tried again; ``ledger`` one row per finished chunk and one per round
    (``chunk`` -1, with the number of chunks), each appended by a job of its
    own after the data it stands for.  What the ledger does not name does not
    count, so a crash at any point leaves a state to go on from.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def entries(self) -> list:
        """The ledger: a row per chunk, so its size is bound by rows / ``CHUNK_ROWS``."""
        try:
            return self.spark.read.schema("round INT, chunk INT, n BIGINT").json(f"{self.root}/ledger").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def commit(self, round_: int, chunk: int, n: int) -> None:
        self.spark.createDataFrame([(round_, chunk, n)], "round INT, chunk INT, n BIGINT").coalesce(1).write.mode("append").json(f"{self.root}/ledger")

    def todo(self, round_: int) -> str:
        return f"{self.root}/round={round_}/todo"

    def out(self, round_: int, chunk: int) -> str:
        return f"{self.root}/round={round_}/out/chunk={chunk}"

    def answers(self, schema) -> DataFrame | None:
        """The rows of all committed chunks, None without any."""
        paths = [self.out(e.round, e.chunk) for e in self.entries() if e.chunk >= 0 and e.n]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None


def _open_chunks(entries: list) -> tuple[int, list[int]]:
    """The last round (-1: none) and its chunks that are not committed."""
    rounds = {e.round: e.n for e in entries if e.chunk < 0}
    if not rounds:
        return -1, []
    last = max(rounds)
    done = {e.chunk for e in entries if e.round == last}
    return last, [c for c in range(rounds[last]) if c not in done]


def label_in_chunks(
    todo: DataFrame,
    root: str,
    text_col: str,
    keys: Sequence[str],
    fn: Labeller = rule_labeller,
    batch_size: int = 25,
    chunk_rows: int = CHUNK_ROWS,
    tasks: int = CHUNK_TASKS,
) -> DataFrame:
    """Label ``todo`` chunk by chunk under ``root``; each chunk that is done is
    committed.  Returns ``(keys..., output, error)`` of all committed rows.

    A call first finishes the round that an earlier call left open, with the
    rows that call had dealt out, then starts one for what is still pending:
    new rows, and rows whose labelling failed with an ``error``.  A chunk has
    some ``chunk_rows`` rows, by a hash of the keys, and is labelled by
    ``tasks`` tasks, which bounds the calls at one time.
    """
    spark, keys, log = todo.sparkSession, list(keys), CommitLog(todo.sparkSession, root)
    todo = todo.select(*keys, text_col)
    schema = batch_label(todo, text_col, keys, fn).schema

    def work(round_: int, chunks: list[int]) -> None:
        dealt = _folders(spark, log.todo(round_)) if chunks else set()
        for c in chunks:
            if c not in dealt:  # no key has this hash
                log.commit(round_, c, 0)
                continue
            rows = spark.read.schema(todo.schema).parquet(f"{log.todo(round_)}/chunk={c}")
            batch_label(rows, text_col, keys, fn, batch_size, tasks).write.mode("overwrite").parquet(log.out(round_, c))
            log.commit(round_, c, spark.read.schema(schema).parquet(log.out(round_, c)).count())

    last, left = _open_chunks(log.entries())
    work(last, left)
    done = log.answers(schema)
    rest = todo if done is None else pending(todo, done, keys)
    n = rest.count()
    if n:
        chunks = -(-n // chunk_rows)
        dealt = rest.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int"))
        dealt.repartition("chunk", F.pmod(F.hash(*keys), F.lit(tasks))).write.mode("overwrite").partitionBy("chunk").parquet(log.todo(last + 1))
        log.commit(last + 1, -1, chunks)
        work(last + 1, list(range(chunks)))
        done = log.answers(schema)
    return latest_outputs(spark.createDataFrame([], schema) if done is None else done, keys)


def _folders(spark: SparkSession, path: str) -> set[int]:
    """Chunks that have rows in a round's folder."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    names = [f.getPath().getName() for f in found]
    return {int(n.removeprefix("chunk=")) for n in names if n.startswith("chunk=")}
