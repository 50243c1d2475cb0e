"""Stored models: Parquet folders below one path, published by a rename."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, CorpusError, ModelError
from ..functions.text import CLEANER_VERSION, SEP, human_bytes
from ..operators.counting import BACKOFF, CODES, Windows, build_stats, in_order
from ..operators.model import backoff, modes_of, row_counts
from ..operators.sequences import spread
from .corpus import MOST_BYTES, POLICIES, fingerprints, malformed_at, read_corpus

SCHEMA_VERSION = "1"
TRANSITIONS = "state string, next_token string, frequency long, mode string"


@dataclass(frozen=True)
class BuildConfig:
    input_path: str
    model_path: str
    order: int = 2
    mode: str = "word"
    errors: str = "strict"
    overwrite: bool = False
    most_paragraph_bytes: int = MOST_BYTES

    def check(self) -> None:
        modes_of(self.mode)
        if self.order < 1:
            raise ConfigurationError("order must be at least 1")
        if self.errors not in POLICIES:
            raise ConfigurationError(f"errors is one of {', '.join(POLICIES)}")
        if self.most_paragraph_bytes < 1024:
            raise ConfigurationError("a paragraph may have 1024 bytes at least")


@dataclass(frozen=True)
class BuildReport:
    model_path: str
    transition_rows: dict[str, int]
    stats: dict[str, int]
    warnings: list[str] = field(default_factory=list)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share; a local master may lack one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="quill-")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_removed, *_path(spark, path))
    return path


def _removed(path, fs) -> None:
    """Deletes what this application alone can still read, when it ends."""
    try:
        fs.delete(path, True)
    except (Py4JError, OSError):
        pass  # the JVM ended first


def scratch(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: plans that use it more than once compute it
    once, and a lost executor costs a re-read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``scratch`` that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p, fs = _path(df.sparkSession, folder)
            fs.delete(p, True)


def space_warning(spark: SparkSession, config: BuildConfig, source_bytes: int) -> str | None:
    """Set if the store has less room than twice (both modes: three times) the source."""
    p, fs = _path(spark, config.model_path)
    need, free = source_bytes * (3 if config.mode == "both" else 2), fs.getStatus(p.getParent() or p).getRemaining()
    return f"{human_bytes(free)} free, {human_bytes(need)} recommended" if free < need else None


def _write_tables(model: DataFrame | Windows, stage: str, tell: Callable[..., None]) -> DataFrame:
    """Both tables of a model below ``stage``; the first as it is read back."""
    spark = model.sparkSession
    if isinstance(model, Windows):
        merged = scratch(model.merged(), "merged")
        held = {r["code"] for r in merged.select("code").distinct().collect()}
        for name, state, more in (("transitions", "state", 0), ("backoff", "last_token", BACKOFF)):
            for mode in model.modes:
                if CODES[mode] + more in held:
                    in_order(merged, CODES[mode] + more).withColumnRenamed("state", state).write.parquet(f"{stage}/{name}/mode={mode}")
            if more == 0:
                tell("merge", 0, 1, "first-order table")
        dropped(merged)
        return spark.read.schema(TRANSITIONS).parquet(f"{stage}/transitions") if held else spark.createDataFrame([], TRANSITIONS)
    model.repartitionByRange("mode", "state").sortWithinPartitions("mode", "state", "next_token").write.partitionBy("mode").parquet(f"{stage}/transitions")
    stored = spark.read.parquet(f"{stage}/transitions")
    tell("merge", 0, 1, "first-order table")
    backoff(stored).repartitionByRange("mode", "last_token").sortWithinPartitions("mode", "last_token", "next_token").write.partitionBy("mode").parquet(f"{stage}/backoff")
    return stored


def write_model(model: DataFrame | Windows, path: str, order: int, mode: str, sources: DataFrame | None = None, extra: dict | None = None, overwrite: bool = False, last_check: Callable[[], None] = lambda: None, tell: Callable[..., None] = lambda *_: None) -> dict[str, int]:
    """Writes all tables to a staging folder and renames it to ``path``; any failure
    removes the staging folder and leaves what was there: a model that is replaced is
    renamed aside first and deleted last.  ``last_check`` runs right before that.  Returns
    rows by mode.

    Files are sorted by state (backoff: by last token), so that min/max statistics let
    a point lookup skip nearly all row groups.  ``Windows`` are counted, dealt out and
    sorted in packed form; any other table is shuffled and sorted as rows.
    """
    spark = model.sparkSession
    final, fs = _path(spark, path)
    if fs.exists(final) and not overwrite:
        raise ModelError(f"{path} exists already")
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    staged, _ = _path(spark, stage)
    aside, _ = _path(spark, stage.replace(".staging-", ".replaced-"))
    try:
        stored = _write_tables(model, stage, tell)
        rows = {r["mode"]: r["transition_rows"] for r in row_counts(stored).collect()}
        for m in modes_of(mode):
            if not rows.get(m):
                raise CorpusError(f"the corpus gives no transitions for mode {m}")
        spark.createDataFrame([(i, m, order, CLEANER_VERSION, True, rows[m]) for i, m in ((1, "word"), (2, "char")) if m in rows], "id int, mode string, state_size int, cleaner_version string, complete boolean, transition_rows long").coalesce(1).write.parquet(f"{stage}/models")
        (sources or spark.createDataFrame([], "path string, size_bytes long, modified_ns long")).write.parquet(f"{stage}/sources")
        told = {"schema_version": SCHEMA_VERSION, "build_complete": "1", "cleaner_version": CLEANER_VERSION, "created_utc": datetime.now(timezone.utc).isoformat(), "order": order, "modes": list(modes_of(mode)), "transition_rows": rows, "encoding": "utf-8"} | (extra or {})
        pairs = [(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in sorted(told.items())]
        spark.createDataFrame(pairs, "key string, value string").coalesce(1).write.parquet(f"{stage}/metadata")
        last_check()
        if fs.exists(final):
            if not overwrite:
                raise ModelError(f"{path} appeared meanwhile")
            if not fs.rename(final, aside):
                raise ModelError(f"{path} could not be renamed")
        if not fs.rename(staged, final):
            if fs.exists(aside):
                fs.rename(aside, final)
            raise ModelError(f"{stage} could not be renamed to {path}")
        fs.delete(aside, True)
    except BaseException:
        fs.delete(staged, True)
        raise
    return rows


class Ticker:
    """Tells, twice a second, how many of the running jobs' tasks are done."""

    def __init__(self, spark: SparkSession, tell: Callable[..., None], phase: str, message: str):
        self.tracker, self.tell, self.phase, self.message = spark.sparkContext.statusTracker(), tell, phase, message
        self.over = threading.Event()

    def __enter__(self):
        self.tell(self.phase, 0, 1, self.message)
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def _run(self) -> None:
        while not self.over.wait(0.5):
            stages = [x for k in self.tracker.getActiveStageIds() if (x := self.tracker.getStageInfo(k))]
            if total := sum(x.numTasks for x in stages):
                self.tell(self.phase, sum(x.numCompletedTasks for x in stages), total, self.message)

    def __exit__(self, *_):
        self.over.set()
        self.thread.join()


def build_model(spark: SparkSession, config: BuildConfig, progress: Callable[[str, int, int, str], None] = lambda *_: None) -> BuildReport:
    """A corpus folder to a stored model.  Sources must be the same before and after.

    ``progress`` is told (phase, done, of, message); phases are scan, index, merge, done.
    """
    config.check()
    final, fs = _path(spark, config.model_path)
    if fs.exists(final) and not config.overwrite:
        raise ModelError(f"{config.model_path} exists already")
    docs = read_corpus(spark, config.input_path, config.errors, config.model_path, config.most_paragraph_bytes)
    before = fingerprints(spark, config.input_path, config.model_path).collect()
    size = sum(r.size_bytes for r in before)
    progress("scan", len(before), len(before), f"{len(before)} files, {human_bytes(size)}")
    warned = space_warning(spark, config, size)

    def same() -> None:
        if fingerprints(spark, config.input_path, config.model_path).collect() != before:
            raise CorpusError("the corpus changed during the build")

    try:
        with Ticker(spark, progress, "index", "paragraphs and observations"):
            stats = build_stats(docs).first().asDict() | {"source_files": len(before), "source_bytes": size, "replacements": docs.agg(F.sum("replacements")).first()[0] or 0}
        same()
        sources = spark.createDataFrame(before, "path string, size_bytes long, modified_ns long")
        extra = {"encoding_errors": config.errors, "source_files": len(before), "source_bytes": size}
        with Ticker(spark, progress, "index", "transitions"):
            rows = write_model(Windows(spread(docs), config.order, modes_of(config.mode)), config.model_path, config.order, config.mode, sources, extra, config.overwrite, same, progress)
    except Exception as bad:
        if found := re.search(r"malformed UTF-8 in (\S+)", str(bad)):
            raise CorpusError(f"invalid UTF-8 in {found[1]} at byte {malformed_at(found[1])}; --encoding-errors replace goes on without it") from bad
        raise
    progress("done", size, size, config.model_path)
    return BuildReport(config.model_path, rows, stats, [warned] if warned else [])


class Model:
    """A stored model, checked when it is opened; answers point lookups."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        p, fs = _path(spark, self.path)
        if not fs.exists(p):
            raise ModelError(f"no model at {path}")
        try:
            self.transitions, self.backoff, self.models = (spark.read.parquet(f"{self.path}/{t}") for t in ("transitions", "backoff", "models"))
            told = self.metadata()
        except Exception as bad:
            raise ModelError(f"{path} is no model: {bad}") from bad
        for key, want in (("schema_version", SCHEMA_VERSION), ("build_complete", "1"), ("cleaner_version", CLEANER_VERSION)):
            if told.get(key) != want:
                raise ModelError(f"{key} is {told.get(key)!r}, not {want!r}")
        self._orders = {r["mode"]: r["state_size"] for r in self.models.where("complete").collect()}

    def metadata(self) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.read.parquet(f"{self.path}/metadata").collect()}

    def sources(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sources")

    def info(self, mode: str):
        found = self.models.where((F.col("mode") == mode) & F.col("complete")).first()
        if found is None:
            raise ModelError(f"the model has no mode {mode}")
        return found

    def order(self, mode: str) -> int:
        if mode not in self._orders:
            raise ModelError(f"the model has no mode {mode}")
        return self._orders[mode]

    def exact(self, mode: str, context: tuple[str, ...]) -> list[tuple[str, int]]:
        rows = self.transitions.where((F.col("mode") == mode) & (F.col("state") == SEP.join(context))).select("next_token", "frequency").collect()
        return sorted((r.next_token, r.frequency) for r in rows)

    def by_last_token(self, mode: str, token: str) -> list[tuple[str, int]]:
        rows = self.backoff.where((F.col("mode") == mode) & (F.col("last_token") == token)).select("next_token", "frequency").collect()
        return sorted((r.next_token, r.frequency) for r in rows)

    def frequency(self, mode: str, context: tuple[str, ...], token: str) -> int:
        return dict(self.exact(mode, context)).get(token, 0)
