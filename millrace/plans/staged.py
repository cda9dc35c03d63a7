"""Transforms over named inputs, and chains of stages that read each other's tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.changes import version_range, without_commit_columns
from millrace.operators.profile import profile_rows
from millrace.operators.writes import OutputSpec, write_json, write_path
from millrace.plans.systables import SYSTEM_TABLES
from millrace.plans.telemetry import CASCADE_NOTE, net_output, touched_output
from millrace.session import hadoop_path, local_frame
from millrace.sources.cursors import CursorTable, read_incremental
from millrace.sources.formats import InputSpec, read_path
from millrace.sources.manifest import FileManifest, read_unread
from millrace.tables.store import Provenance, VersionedTable, read_feed

Transform = str | Callable[[SparkSession, dict[str, DataFrame]], dict[str, DataFrame]]


def sql_transform(spark: SparkSession, sql: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Run a query in which every input is a view under its alias."""
    for alias, df in inputs.items():
        df.createOrReplaceTempView(alias)
    return spark.sql(sql)


def run_transform(spark: SparkSession, transform: Transform, inputs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The outputs by key: `default` for a SQL text, whatever a function returns otherwise."""
    if isinstance(transform, str):
        return {"default": sql_transform(spark, transform, inputs)}
    if not callable(transform):
        raise TypeError("a transform is a SQL text or a function (spark, inputs) -> dict of frames")
    outputs = transform(spark, dict(inputs))
    if not isinstance(outputs, dict):
        raise TypeError("transform must return a dict of output name -> DataFrame")
    return outputs


def python_transform(source: str) -> Transform:
    """The `transform` function a module text defines."""
    scope: dict[str, object] = {}
    exec(compile(source, "transform", "exec"), scope)  # the user's own transform, as given
    if "transform" not in scope:
        raise ValueError("the module must define transform(spark, inputs)")
    return scope["transform"]


@dataclass
class Stage:
    """One step of a chain: inputs by alias (tables of the chain, paths, or frames), outputs by key. `incremental`
    names the table inputs that are read as feeds; a path input with partition columns always is."""

    name: str
    transform: Transform
    inputs: Mapping[str, str | InputSpec | DataFrame]
    outputs: Mapping[str, OutputSpec] = field(default_factory=lambda: {"default": OutputSpec()})
    incremental: Sequence[str] = ()


    def table_name(self, key: str, sole: bool) -> str:
        """The table that an output is written to, unless its description names another."""
        named = self.outputs[key].target if key in self.outputs else ""
        return named or (self.name if sole else f"{self.name}__{key}")

    def writes(self, table: str) -> bool:
        """Whether a table is one of the stage's outputs."""
        own = {self.table_name(key, list(self.outputs) == ["default"]) for key, spec in self.outputs.items() if spec.kind == "table"}
        return table in own or table == self.name or table.startswith(f"{self.name}__")


@dataclass(frozen=True)
class StageResult:
    stage: str
    status: str  # ok, skipped, failed
    error: str = ""


class Chain:
    """Stages in the order given, each reading tables the earlier ones wrote. What each run did goes to the telemetry
    tables below `<path>/_system`: a `node_runs` row for each stage, skipped ones included, a `tables` row for each table
    written, and `column_stats` where an output asks for statistics. Each of them is written once, when the run ends."""

    def __init__(self, spark: SparkSession, path: str, pipeline: str = "chain"):
        self.spark = spark
        self.path = path.rstrip("/")
        self.pipeline = pipeline
        self.cursors = CursorTable(spark, f"{self.path}/_cursors")
        self.files = FileManifest(spark, f"{self.path}/_files")
        self._rows: dict[str, list[dict]] = {}
        self._stats: list[DataFrame] = []

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.path}/{name}")

    def system(self, name: str) -> DataFrame:
        """One of the telemetry tables; empty before the first run."""
        path, schema = f"{self.path}/_system/{name}", SYSTEM_TABLES[name]
        fs, jpath = hadoop_path(self.spark, path)
        return self.spark.read.schema(schema).parquet(path) if fs.exists(jpath) else self.spark.createDataFrame([], schema)

    def _tell(self, name: str, **values: object) -> None:
        """Note a row of a telemetry table; columns not given are NULL."""
        self._rows.setdefault(name, []).append(values)

    def _write_telemetry(self) -> None:
        """Append what the run has noted."""
        for name, rows in self._rows.items():
            fields = StructType.fromDDL(SYSTEM_TABLES[name])
            local_frame(self.spark, rows, fields).coalesce(1).write.mode("append").parquet(f"{self.path}/_system/{name}")
        if self._stats:
            fields = StructType.fromDDL(SYSTEM_TABLES["column_stats"])
            rows = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), self._stats)
            have = set(rows.columns)
            columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
            rows.select(*columns).write.mode("append").parquet(f"{self.path}/_system/column_stats")
        self._rows, self._stats = {}, []

    def _read(self, stage: Stage, alias: str, source: str | InputSpec | DataFrame, forced: bool) -> tuple[DataFrame | None, Callable[[], None] | None]:
        """(frame or None if there is nothing new, what to do once the outputs are written)."""
        if isinstance(source, DataFrame):
            return source, None
        if isinstance(source, InputSpec):
            if source.late_files:
                files = read_unread(self.files, stage.name, source.source, source.format, source.options, forced=forced)
                return files.df, files.done
            if not source.partitions:
                return read_path(self.spark, source.source, source.format, source.options), None
            got = read_incremental(
                self.spark, self.cursors, stage.name, source.source, source.partitions, source.format, source.start_from, forced
            )
            return got.df, partial(self.cursors.advance, stage.name, source.source, got.cursor) if got.cursor else None
        table = self.table(source)
        if alias not in stage.incremental:
            return table.read(), None
        stored = self.cursors.get(stage.name, source)
        feed = read_feed(table, int(stored[0]) if stored else None, forced=forced)
        return feed.df, None if feed.version is None else partial(self.cursors.advance, stage.name, source, (str(feed.version),))

    def _write(self, stage: Stage, key: str, name: str, df: DataFrame, spec: OutputSpec, by: Provenance) -> int | None:
        """Write an output by its kind; if it is a table, the rows it has gained."""
        if spec.kind == "json_object":
            write_json(df, spec.target or f"{self.path}/{name}.json")
            return None
        if spec.kind == "path":
            if spec.mode == "merge":
                raise ValueError("a path output can't be merged into")
            write_path(df, spec.target, spec.mode)
            if spec.stats:
                self._profile(stage, key, spec.target, self.spark.read.parquet(spec.target), None, "table", by)
            return None
        table = self.table(name)
        version = table.write(df, spec, by)
        head = table.commit()
        self._tell(
            "tables", pipeline=self.pipeline, node=stage.name, output_key=key, table_name=name, table_id=table.path, snapshot_id=version,
            snapshot_ts=head["committed_at"], row_count=touched_output(head), file_count=head["file_count"], total_bytes=head["total_bytes"],
            last_writer_run_id=head["run_id"],
        )
        if spec.stats:
            batch = spec.mode in ("append", "merge") and version > 0
            rows = table.read()
            if batch:  # what this commit has written, inserts and updated rows
                rows = without_commit_columns(version_range(table.changes(version - 1, version), version - 1, version))
            self._profile(stage, key, table.path, rows, version, "batch" if batch else "table", by)
        return net_output(head)

    def _profile(self, stage: Stage, key: str, identifier: str, rows: DataFrame, version: int | None, scope: str, by: Provenance) -> None:
        stats = profile_rows(rows, run_id=by.run_id, table=identifier, version=version, scope=scope)
        told = {"pipeline": F.lit(self.pipeline), "node": F.lit(stage.name), "output_key": F.lit(key), "snapshot_ts": F.lit(datetime.now(timezone.utc))}
        self._stats.append(stats.withColumns(told))

    def _note_stage(self, result: StageResult, began: datetime, by: Provenance, rows: int | None = None, error_class: str | None = None) -> None:
        ended = datetime.now(timezone.utc)
        self._tell(
            "node_runs", run_id=by.run_id, pipeline=self.pipeline, node=result.stage, started_at=began, ended_at=ended,
            duration_ms=int((ended - began).total_seconds() * 1000), status=result.status, compute_target="local", error_class=error_class,
            error_msg=result.error[:1000] or None, output_rows=rows,
        )

    def _try_stage(self, stage: Stage, by: Provenance, forced: bool) -> StageResult:
        began = datetime.now(timezone.utc)
        try:
            result, rows = self._run_stage(stage, by, forced)
            kind = None
        except Exception as error:  # reported as the stage's result
            result, rows, kind = StageResult(stage.name, "failed", str(error)), None, type(error).__name__
        self._note_stage(result, began, by, rows, kind)
        return result

    def run_stage(self, stage: Stage, by: Provenance, forced: bool = False) -> StageResult:
        """One stage as a run of its own."""
        result = self._try_stage(stage, by, forced)
        self._write_telemetry()
        return result

    def _run_stage(self, stage: Stage, by: Provenance, forced: bool) -> tuple[StageResult, int | None]:
        inputs, done = {}, []
        for alias, source in stage.inputs.items():
            df, after = self._read(stage, alias, source, forced)
            if df is None:
                return StageResult(stage.name, "skipped"), None
            inputs[alias] = df
            if after is not None:
                done.append(after)
        outputs = run_transform(self.spark, stage.transform, inputs)
        rows = None
        for key, df in outputs.items():
            name = stage.table_name(key, list(outputs) == ["default"])
            wrote = self._write(stage, key, name, df, stage.outputs.get(key, OutputSpec()), by)
            rows = rows if wrote is None else (rows or 0) + wrote
        for after in done:  # only now: a crash before this repeats the batch
            after()
        return StageResult(stage.name, "ok"), rows

    def run(
        self, stages: Sequence[Stage], by: Provenance = Provenance(), forced: bool | Sequence[str] = False
    ) -> list[StageResult]:
        """Stop at the first failure. A stage is skipped when it has parents in the chain, by the tables that they write,
        and all of them had nothing new."""
        results: dict[str, StageResult] = {}
        ran: list[Stage] = []
        try:
            for stage in stages:
                tables = [s for s in stage.inputs.values() if isinstance(s, str)]
                parents = [results[p.name] for p in ran if any(p.writes(t) for t in tables)]
                must = forced is True or (not isinstance(forced, bool) and stage.name in forced)
                ran.append(stage)
                if parents and all(p.status == "skipped" for p in parents) and not must:
                    results[stage.name] = StageResult(stage.name, "skipped", CASCADE_NOTE)
                    self._note_stage(results[stage.name], datetime.now(timezone.utc), by)
                    continue
                results[stage.name] = self._try_stage(stage, by, must)
                if results[stage.name].status == "failed":
                    break
        finally:
            self._write_telemetry()
        return list(results.values())
