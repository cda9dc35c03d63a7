"""A versioned table as plain Parquet directories and a Parquet commit log.

    <path>/data/_v=<n>/_k=<kind>/...   rows that commit n wrote
    <path>/dirs/version=<n>/           the directories that commit n added and dropped
    <path>/log/version=<n>/            the commit's row; writing it publishes the commit

A commit writes each row once, under its kind: `keep` (rewritten as it was), `insert`, `post` (a row after an update)
and `pre` (the row before it). The first three are the table's contents, the last three the commit's change rows, so
there is no second copy of either. A merge rewrites the directories that hold a matching key, whole, and drops their
former entries. What a commit stores grows with what it touches, not with the table's history. One writer per table;
readers see the highest published version.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.operators import changes as ch
from millrace.operators import merge as mg
from millrace.operators.schema import evolve, shape
from millrace.operators.writes import OutputSpec, clustered
from millrace.session import freeze, hadoop_path, local_frame, session_conf
from millrace.sources.sampling import file_listing

COMMIT_SCHEMA = """
committed_at timestamp, operation string, replaces boolean, base bigint, feed_from bigint,
partition_by array<string>, merge_keys array<string>, cluster_by array<string>, schema string,
inserted bigint, updated bigint, deleted bigint, output_rows bigint, total_rows bigint,
file_count bigint, total_bytes bigint, trigger string, run_id string, streams map<string, bigint>
"""
LOG_SCHEMA = f"{COMMIT_SCHEMA}, version bigint"
DIRS_SCHEMA = "action string, path string, kind string, partition string, files bigint, bytes bigint, version bigint"
_VERSION, _KIND = "_v", "_k"
_FOLDER = r"/data/(_v=[0-9]+/.*)/[^/]+$"
KINDS = ("keep", "pre", "post", "insert")
#: Fixed value: the name Spark gives to a partition of NULL.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_MARK = "~"
#: Kinds of rows, as change types where they are changes.
CHANGE_TYPES = {"insert": "insert", "pre": "update_preimage", "post": "update_postimage"}
APPENDING = ("CREATE", "WRITE", "APPEND")
TARGET_FILE_BYTES = 128 * 1024 * 1024


def _file_path() -> Column:
    """A row's file, as the file system names it (the metadata column is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _folder() -> Column:
    return F.regexp_extract(_file_path(), _FOLDER, 1)


def _marked(text: Column) -> Column:
    odd = (text == "") | (text == NULL_PARTITION) | text.startswith(_MARK)
    return F.when(odd, F.concat(F.lit(_MARK), text)).otherwise(text)


def _unmarked(text: Column) -> Column:
    return F.when(text.startswith(_MARK), F.substring(text, len(_MARK) + 1, F.length(text))).otherwise(text)


def _texts(schema: StructType, parts: Sequence[str]) -> list[str]:
    return [p for p in parts if p in schema.names and schema[p].dataType == StringType()]


def _tuple(columns: Sequence[str]) -> Column:
    """Values of partition columns as one text, NULLs included."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])) if columns else F.lit("[]")


class FeedError(LookupError):
    """Change rows that cannot be given whole: a type has changed, or they have expired."""


@dataclass(frozen=True)
class Provenance:
    """Who wrote a commit; for a stream, its name and batch."""

    run_id: str = ""
    trigger: str = "manual"
    stream: tuple[str, int] | None = None


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark = spark
        self.path = path.rstrip("/")
        self._partition_by = list(partition_by)
        self._written: Row | None = None  # the commit row that this object has written last

    # -- the commit log

    def _exists(self, path: str) -> bool:
        fs, jpath = hadoop_path(self.spark, path)
        return fs.exists(jpath)

    def _delete(self, path: str) -> None:
        fs, jpath = hadoop_path(self.spark, path)
        fs.delete(jpath, True)

    def log(self) -> DataFrame:
        """All commits; a filter on `version` prunes."""
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.path}/log")

    def _versions(self) -> list[int]:
        """The versions there are, oldest first, from directory names."""
        if not self._exists(f"{self.path}/log"):
            return []
        fs, jpath = hadoop_path(self.spark, f"{self.path}/log")
        names = [s.getPath().getName() for s in fs.listStatus(jpath) if s.isDirectory()]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def log_of(self, versions: Sequence[int]) -> DataFrame:
        """Commits by version, without listing the rest of the log."""
        if not versions:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        root = f"{self.path}/log"
        reader = self.spark.read.option("basePath", root).schema(LOG_SCHEMA)
        return reader.parquet(*[f"{root}/version={v}" for v in versions])

    def commit(self, version: int | None = None) -> Row | None:
        """The commit row of a version (the newest one not above it), or of the head. A long history costs
        a listing and one small file."""
        for v in reversed(self._versions()):
            if version is None or v <= version:
                if self._written is not None and self._written["version"] == v:
                    return self._written
                row = self.log_of([v]).first()
                if row is not None:  # a directory without a row is a commit that was not published
                    return row
        return None

    def version(self) -> int | None:
        head = self.commit()
        return head["version"] if head else None

    def has_batch(self, stream: str, batch: int) -> bool:
        """Whether the table holds a stream's batch; the head knows the last one of each stream."""
        head = self.commit()
        return head is not None and (head["streams"] or {}).get(stream, -1) >= batch

    # -- directories

    def _told(self, commit: Row) -> DataFrame:
        """The last that commits have told of each directory: path, and a struct with its action."""
        told = self.spark.read.schema(DIRS_SCHEMA).parquet(f"{self.path}/dirs").where(F.col("version").between(commit["base"], commit["version"]))
        return told.groupBy("path").agg(F.max_by(F.struct("action", "kind", "partition", "files", "bytes"), F.struct("version", "action")).alias("d"))

    def dirs(self, commit: Row | None = None) -> DataFrame:
        """The directories that make up the table as of a commit: path, kind, partition, files, bytes."""
        commit = commit or self.commit()
        if commit is None:
            return self.spark.createDataFrame([], DIRS_SCHEMA)
        return self._told(commit).where("d.action = 'add' AND d.kind <> 'pre'").select("path", "d.*").drop("action")

    def _describe(self, version: int, schema: StructType, parts: Sequence[str]) -> DataFrame:
        """What a commit has written, by directory, from a listing of its files; none is opened."""
        target = f"{self.path}/data/{_VERSION}={version}"
        files = file_listing(self.spark, target).select(F.regexp_extract("path", _FOLDER, 1).alias("path"), "bytes")
        by_dir = files.groupBy("path").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        levels, values = F.split("path", "/"), []
        for i, p in enumerate(parts):
            text = F.substring_index(F.get(levels, F.lit(2 + i)), "=", -1)
            text = F.nullif(F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), F.lit(NULL_PARTITION))
            values.append(_unmarked(text) if p in _texts(schema, parts) else text)
        partition = F.to_json(F.array(*values)) if values else F.lit("[]")
        kind = F.substring_index(F.get(levels, F.lit(1)), "=", -1)
        return by_dir.select(F.lit("add").alias("action"), "path", kind.alias("kind"), partition.alias("partition"), "files", "bytes")

    # -- reading

    def _read_paths(self, paths: Sequence[str], schema: StructType, parts: Sequence[str], folder: bool = False) -> DataFrame:
        """Rows below directories, with their version and kind, and on demand their `_folder`."""
        root = f"{self.path}/data"
        full = StructType([*schema.fields, StructField(_VERSION, LongType()), StructField(_KIND, StringType())])
        if not paths:
            rows = self.spark.createDataFrame([], full)
            return rows.withColumn("_folder", F.lit("")) if folder else rows
        rows = self.spark.read.option("basePath", root).schema(full).parquet(*[f"{root}/{p}" for p in paths])
        texts = _texts(schema, parts)
        columns = [_unmarked(F.col(f"`{n}`")).alias(n) if n in texts else F.col(f"`{n}`") for n in full.names]
        return rows.select(*columns, *([_folder().alias("_folder")] if folder else []))

    def _paths(self, dirs: DataFrame) -> list[str]:
        """The paths of some directories."""
        return sorted(r["path"] for r in dirs.select("path").collect())

    def _all_paths(self, commit: Row) -> list[str]:
        """Paths that hold the table as of a commit and nothing else: one for each version, or kind of a version, that is
        live as a whole, and one for each other directory."""
        live = F.col("d.action") == "add"
        groups = self._told(commit).groupBy(F.substring_index("path", "/", 2).alias("at")).agg(
            F.bool_and(live).alias("whole"), F.when(~F.bool_and(live), F.collect_list(F.when(live, F.col("path")))).alias("some")
        )
        by_version: dict[str, list[Row]] = {}
        for r in groups.collect():
            by_version.setdefault(r["at"].split("/")[0], []).append(r)
        out: list[str] = []
        for version, kinds in by_version.items():
            shown = [r for r in kinds if not r["at"].endswith("=pre")]
            if len(shown) == len(kinds) and all(r["whole"] for r in kinds):
                out.append(version)
                continue
            for r in shown:
                out += [r["at"]] if r["whole"] else r["some"]
        return sorted(out)

    def contents(self, commit: Row) -> DataFrame:
        """The table as of a commit row."""
        schema = StructType.fromJson(json.loads(commit["schema"]))
        return self._read_paths(self._all_paths(commit), schema, commit["partition_by"]).select(*[f"`{n}`" for n in schema.names])

    @staticmethod
    def _fitted(df: DataFrame, schema: StructType, keep: Sequence[str] = ()) -> DataFrame:
        """Rows of an earlier schema in the newest one. A type that has changed is an error, not a NULL."""
        have = dict(shape(df.schema))
        for f in schema:
            if f.name in have and have[f.name] != f.dataType.simpleString():
                raise FeedError(f"column {f.name!r} was {have[f.name]} and is {f.dataType.simpleString()} now: read the table in full")
        columns = [F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        return df.select(*keep, *columns)

    def read(self, version: int | None = None) -> DataFrame:
        """The table now, or as it was at a version."""
        commit = self.commit(version)
        if commit is None:
            raise LookupError(f"{self.path} has no commit" + ("" if version is None else f" <= {version}"))
        return self.contents(commit)

    def read_if_any(self) -> DataFrame | None:
        commit = self.commit()
        return self.contents(commit) if commit else None

    def changes(self, after: int = -1, upto: int | None = None) -> DataFrame:
        """Change rows of the commits in `(after, upto]` with type, version and time. Commits that only
        rearrange files have none. Raises FeedError if they can't be given whole."""
        versions = [v for v in self._versions() if v >= after and (upto is None or v <= upto)]
        if not versions:
            raise LookupError(f"{self.path} has no commit from {after} on")
        log = self.log_of(versions)
        commits = log.orderBy("version").collect()  # a row a commit of the range
        newest = commits[-1]
        if after < (newest["feed_from"] or 0) - 1:
            raise FeedError(f"change rows before version {newest['feed_from']} have expired")
        former = commits.pop(0) if commits[0]["version"] == after else None
        schema = StructType.fromJson(json.loads(newest["schema"]))
        names = [f"`{n}`" for n in schema.names]
        times = log.select(F.col("version").alias("_commit_version"), F.col("committed_at").alias("_commit_timestamp"))

        parts: list[DataFrame] = []
        by_schema: dict[str, list[str]] = {}  # commits of one schema are read together
        for c in commits:
            by_schema.setdefault(c["schema"], []).append(f"{_VERSION}={c['version']}")
            if c["replaces"] and former is not None:
                gone = self._fitted(self.contents(former), schema)
                parts.append(gone.select(F.lit("delete").alias("_change_type"), *names, F.lit(c["version"]).cast("bigint").alias("_commit_version")))
            former = c
        kind = F.create_map(*[F.lit(x) for pair in CHANGE_TYPES.items() for x in pair])[F.col(_KIND)].alias("_change_type")
        for text, paths in by_schema.items():
            there = [p for p in paths if self._exists(f"{self.path}/data/{p}")]
            rows = self._read_paths(there, StructType.fromJson(json.loads(text)), newest["partition_by"]).where(F.col(_KIND) != "keep")
            parts.append(self._fitted(rows, schema, keep=[_KIND, _VERSION]).select(kind, *names, F.col(_VERSION).alias("_commit_version")))
        if not parts:
            fields = [StructField("_change_type", StringType()), *schema.fields, StructField("_commit_version", LongType())]
            parts.append(self.spark.createDataFrame([], StructType(fields)))
        rows = reduce(DataFrame.unionByName, parts).join(times, "_commit_version")
        return rows.select("_change_type", *names, "_commit_version", "_commit_timestamp")

    # -- writing

    def _write(self, df: DataFrame, version: int, parts: Sequence[str], kind: str | None = None) -> dict[str, int]:
        """Write a commit's rows, which have their kind unless all are of one; how many of each. They are counted by the
        tasks that write them, behind the last shuffle, so that a task that runs again counts once."""
        target = f"{self.path}/data/{_VERSION}={version}"
        rows = df.hint("rebalance", *([] if kind else [_KIND]), *parts) if parts else df
        seen = Observation()
        rows = rows.observe(seen, *[F.count_if(F.lit(k == kind) if kind else F.col(_KIND) == k).alias(k) for k in KINDS])
        rows = rows.withColumns({p: _marked(F.col(f"`{p}`")) for p in _texts(df.schema, parts)})
        if kind:  # a constant beside the write needs no sort by it, which would hold all that a task writes
            rows = self._of_kind(rows, kind)
        rows.write.mode("overwrite").partitionBy(_KIND, *parts).parquet(target)
        return seen.get

    def _commit(
        self,
        head: Row | None,
        rows: DataFrame,
        operation: str,
        schema: StructType,
        by: Provenance,
        dropped: DataFrame | None = None,
        merge_keys: Sequence[str] | None = None,
        cluster_by: Sequence[str] = (),
        replaces: bool = False,
        rebase: bool = False,
        kind: str | None = None,
    ) -> int:
        """Write rows with their kind (or all of one), then the directories, then the commit's row. `dropped` are directories that
        the commit takes out; `rebase` says that these are all there were."""
        version = head["version"] + 1 if head else 0
        parts = list(head["partition_by"]) if head else self._partition_by
        kinds = self._write(rows, version, parts, kind)
        told = self._describe(version, schema, parts)
        if dropped is not None:
            gone = dropped.select(F.lit("drop").alias("action"), "path", "kind", "partition", "files", "bytes")
            told = told.unionByName(gone)
        seen = Observation()
        live = F.when(F.col("kind") != "pre", F.when(F.col("action") == "add", 1).otherwise(-1)).otherwise(0)
        sums = [F.coalesce(F.sum(F.col(c) * live), F.lit(0)).alias(c) for c in ("files", "bytes")]
        told.coalesce(1).observe(seen, *sums).write.mode("overwrite").parquet(f"{self.path}/dirs/version={version}")
        moved = seen.get
        start = {"file_count": 0, "total_bytes": 0, "total_rows": 0} if head is None else head.asDict()
        row = {
            "operation": operation, "replaces": replaces, "base": version if head is None or rebase else head["base"],
            "feed_from": head["feed_from"] if head else 0, "partition_by": parts, "schema": schema.json(),
            "merge_keys": list(merge_keys) if merge_keys is not None else list(head["merge_keys"]) if head else [],
            "cluster_by": list(cluster_by) or (list(head["cluster_by"]) if head else []),
            "inserted": kinds["insert"] if operation in (*APPENDING, "MERGE") else None,
            "updated": kinds["post"] if operation == "MERGE" else None, "deleted": 0 if operation == "MERGE" else None,
            "output_rows": kinds["insert"] if operation in APPENDING else None,
            "file_count": start["file_count"] + moved["files"],
            "total_bytes": start["total_bytes"] + moved["bytes"],
            "total_rows": kinds["insert"] + (0 if replaces else start["total_rows"]),
            "trigger": by.trigger, "run_id": by.run_id, "streams": dict(head["streams"] or {}) if head else {},
        }
        if by.stream:
            row["streams"][by.stream[0]] = by.stream[1]
        return self._publish(version, row)

    def _publish(self, version: int, row: Mapping) -> int:
        fields = StructType.fromDDL(COMMIT_SCHEMA)
        now = datetime.now(timezone.utc)
        local_frame(self.spark, [dict(row) | {"committed_at": now}], fields).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        values = dict(row) | {"committed_at": now, "version": version}
        self._written = Row(**{n: values[n] for n in (*fields.names, "version")})
        return version

    @staticmethod
    def _of_kind(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn(_KIND, F.lit(kind))

    def replace(
        self,
        df: DataFrame,
        by: Provenance = Provenance(),
        cluster_by: Sequence[str] = (),
        merge_keys: Sequence[str] = (),
    ) -> int:
        """The output becomes the table, schema included. The layout columns are remembered."""
        head = self.commit()
        layout = list(cluster_by) or [c for c in (head["cluster_by"] if head else ()) if c in df.columns]
        dropped = self.dirs(head) if head else None
        operation = "WRITE" if head else "CREATE"
        return self._commit(head, clustered(df, layout), operation, df.schema, by, dropped, merge_keys, layout, replaces=True, rebase=True, kind="insert")

    def append(self, df: DataFrame, by: Provenance = Provenance(), cluster_by: Sequence[str] = ()) -> int:
        """Add a batch, in time proportional to the batch; new columns read NULL in older rows."""
        head = self.commit()
        if head is None:
            return self.replace(df, by, cluster_by)
        layout = list(cluster_by) or list(head["cluster_by"])
        schema = evolve(self._empty(head), df.schema).schema
        rows = clustered(df, [c for c in layout if c in df.columns])
        return self._commit(head, rows, "APPEND", schema, by, cluster_by=layout, kind="insert")

    def _empty(self, head: Row) -> DataFrame:
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(head["schema"])))

    def merge(
        self,
        df: DataFrame,
        keys: Sequence[str],
        update: Mapping[str, str] | None = None,
        bound_by: Sequence[str] = (),
        by: Provenance = Provenance(),
        cluster_by: Sequence[str] = (),
    ) -> int:
        """Keyed upsert. The first one creates the table. When every partition column is a key or named in
        `bound_by`, the partitions that occur in the batch are rewritten. Otherwise the keys within the batch's
        bounds are scanned for the directories that hold a match, and those are."""
        head = self.commit()
        if head is None:
            return self.replace(df, by, cluster_by, keys)
        parts, layout = list(head["partition_by"]), list(cluster_by) or list(head["cluster_by"])
        batch = f"{self.path}/batches/{_VERSION}={head['version'] + 1}"
        source = freeze(df, batch)  # read for the bound, the directories and the rows
        mg.require_bound(source, keys, bound_by)
        schema = StructType.fromJson(json.loads(head["schema"]))
        live, present = self.dirs(head), None
        if parts and all(p in keys or p in bound_by for p in parts):
            wanted = source.select(_tuple(parts).alias("partition")).distinct()
            hit = live.join(wanted, "partition", "left_semi")
        else:
            table = self._read_paths(self._all_paths(head), schema, parts, folder=True)
            # there is nothing to skip in a table of less than a file
            inside = mg.split_by_bound(table, source, keys, layout, bound_by)[0] if head["total_bytes"] > TARGET_FILE_BYTES else table
            names = [F.col(f"`{k}`") for k in keys]
            found = inside.select(*names, "_folder").join(source.select(*names).distinct(), list(keys), "left_semi")
            found = freeze(found, f"{batch}-found")  # read for the directories, and to tell inserts
            hit = live.join(found.select(F.col("_folder").alias("path")).distinct(), "path", "left_semi")
            present = found.select(*names).distinct()
        named = hit.select("path", "kind", "partition", "files", "bytes").collect()  # a scan is planned by paths anyway
        hit = local_frame(self.spark, [r.asDict() for r in named], "path string, kind string, partition string, files bigint, bytes bigint")
        touched = self._read_paths(sorted(r["path"] for r in named), schema, parts).select(*[f"`{n}`" for n in schema.names])
        mg.require_single_match(touched, source, keys)
        merged = mg.merge_parts(touched, source, keys, update, present)
        rows = merged.by_kind(_KIND)
        rows = clustered(rows, [c for c in layout if c in rows.columns])
        schema = evolve(self._empty(head), source.schema).schema
        version = self._commit(head, rows, "MERGE", schema, by, hit, keys, layout)
        for name in (batch, f"{batch}-found"):
            self._delete(name)
        return version

    def write(self, df: DataFrame, spec: OutputSpec, by: Provenance = Provenance()) -> int:
        if spec.mode == "merge":
            return self.merge(df, spec.merge_keys, spec.merge_update, spec.bound_by, by, spec.layout_columns())
        if spec.mode == "append":
            return self.append(df, by, spec.cluster_by)
        return self.replace(df, by, spec.cluster_by)

    def rewrite(self, df: DataFrame, operation: str, by: Provenance = Provenance(), cluster_by: Sequence[str] = (), dropped: DataFrame | None = None) -> int:
        """Publish the same rows in other files: no change rows. All directories are rewritten unless some are named."""
        head = self.commit()
        schema = StructType.fromJson(json.loads(head["schema"]))
        old = self.dirs(head) if dropped is None else dropped
        return self._commit(head, df, operation, schema, by, old, None, cluster_by, rebase=dropped is None, kind="keep")

    def compact(self, target_bytes: int = TARGET_FILE_BYTES, by: Provenance = Provenance()) -> int:
        """Fewer, larger files: directories of a partition whose files are under half the target on average are
        rewritten, if they have several files between them. Spark packs small files into read tasks of the target
        size and each task writes one file, so nothing is shuffled (partitioned tables rebalance by partition). The
        head stays as it is if there is nothing to do."""
        head = self.commit()
        small = self.dirs(head).where(F.col("bytes") < F.col("files") * (target_bytes / 2))
        several = small.groupBy("partition").agg(F.sum("files").alias("n")).where("n > 1").select("partition")
        small = small.join(several, "partition", "left_semi")
        paths = self._paths(small)
        if not paths:
            return head["version"]
        schema = StructType.fromJson(json.loads(head["schema"]))
        with session_conf(
            self.spark,
            spark__sql__files__maxPartitionBytes=str(target_bytes),
            spark__sql__files__openCostInBytes="0",
            spark__sql__files__minPartitionNum="1",
        ):
            rows = self._read_paths(paths, schema, head["partition_by"]).select(*[f"`{n}`" for n in schema.names])
            return self.rewrite(rows, "COMPACT", by, dropped=small)

    # -- files

    def files(self, version: int | None = None) -> DataFrame:
        """`path, modified_at, bytes` of the files a version consists of."""
        commit = self.commit(version)
        listed = file_listing(self.spark, f"{self.path}/data")
        if commit is None:
            return listed.limit(0)
        live = self.dirs(commit).select(F.col("path").alias("folder"))
        inside = listed.withColumn("folder", F.regexp_extract("path", _FOLDER, 1))
        return inside.join(live, "folder", "left_semi").drop("folder")

    def expired(self, retention_hours: float) -> DataFrame:
        """Directories that no version within the retention needs: dropped, or before an update, by a commit older than
        that, and not deleted by an earlier expiry. `path, version` (the one that wrote it)."""
        cutoff = F.current_timestamp() - F.expr(f"make_dt_interval(0, 0, 0, {float(retention_hours) * 3600})")
        old = self.log().where(F.col("committed_at") < cutoff).select("version")
        told = self.spark.read.schema(DIRS_SCHEMA).parquet(f"{self.path}/dirs")
        done = told.where("action = 'expire'").select("path")
        told = told.where("action <> 'expire'").join(old, "version", "left_semi")
        gone = told.where((F.col("action") == "drop") | (F.col("kind") == "pre")).select("path").distinct()
        added = told.where(F.col("action") == "add").select("path", "version")
        return added.join(gone, "path", "left_semi").join(done, "path", "left_anti")

    def expire(self, retention_hours: float, by: Provenance = Provenance(trigger="maintenance")) -> int:
        """Delete the expired directories; how many. The oldest version that a feed can still start from goes into
        the log, and what was deleted beside it, so that no later expiry looks for it again. Time travel reaches back as
        far. A whole version that has expired is one deletion."""
        head = self.commit()
        version = head["version"] + 1
        beside = f"{self.path}/dirs/version={version}"
        seen = Observation()
        gone = self.expired(retention_hours).select(F.lit("expire").alias("action"), "path", *[F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("partition", "string"), ("files", "bigint"), ("bytes", "bigint"))])
        gone.observe(seen, F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(beside)
        n = seen.get["n"]
        if not n:
            self._delete(beside)
            return 0
        names = self._whole_paths(beside)
        cutoff = F.current_timestamp() - F.expr(f"make_dt_interval(0, 0, 0, {float(retention_hours) * 3600})")
        young = self.log().where(F.col("committed_at") >= cutoff).agg(F.min("version")).first()[0]
        row = head.asDict() | {"operation": "EXPIRE", "replaces": False, "inserted": 0, "updated": 0, "output_rows": None, "feed_from": version if young is None else young, "trigger": by.trigger, "run_id": by.run_id}
        self._publish(version, row)
        for name in names:
            self._delete(f"{self.path}/data/{name}")
        return n

    def _whole_paths(self, beside: str) -> list[str]:
        """What an expiry deletes, by version or kind where nothing else is left below it."""
        told = self.spark.read.schema(DIRS_SCHEMA).parquet(f"{self.path}/dirs")
        added = told.where("action = 'add'").select("path")
        gone = told.where("action = 'expire'").select("path").unionByName(self.spark.read.parquet(beside).select("path")).distinct()
        now = self.spark.read.parquet(beside).select("path", F.lit(True).alias("now"))
        left = added.join(gone.withColumn("gone", F.lit(True)), "path", "left").join(now, "path", "left")
        kinds = left.groupBy(F.substring_index("path", "/", 2).alias("at")).agg(
            F.bool_and(F.col("gone").isNotNull()).alias("whole"), F.bool_or(F.col("now").isNotNull()).alias("any"),
            F.when(~F.bool_and(F.col("gone").isNotNull()), F.collect_list(F.when(F.col("now"), F.col("path")))).alias("some"),
        )
        versions = kinds.groupBy(F.substring_index("at", "/", 1).alias("version")).agg(
            F.bool_and("whole").alias("whole"), F.bool_or("any").alias("any"), F.collect_list(F.when(F.col("any"), F.struct("at", "whole", "some"))).alias("kinds")
        )
        out: list[str] = []
        for v in versions.where("any").collect():
            if v["whole"]:
                out.append(v["version"])
            else:
                out += [name for k in v["kinds"] for name in ([k["at"]] if k["whole"] else k["some"])]
        return sorted(out)


@dataclass(frozen=True)
class FeedRead:
    """One read of a producer's table, and the version to store once it is consumed."""

    df: DataFrame | None
    version: int | None
    full: bool = False

    @property
    def skipped(self) -> bool:
        return self.df is None


def read_feed(
    table: VersionedTable,
    last: int | None,
    keys: Sequence[str] | None = None,
    forced: bool = False,
    deletes: bool = False,
) -> FeedRead:
    """Decide what a consumer that saw version `last` has to read.

    No commit: skip. Never read, or the table was rebuilt and counts from the start again: everything. Nothing new:
    skip, or everything if forced; otherwise force changes nothing. Behind: the change rows since then, the newest
    per key of the producer (the keys it merges on, unless others are given); everything if they can't be given whole,
    because a type has changed or they have expired.
    """
    head = table.commit()
    if head is None:
        return FeedRead(None, None)
    current = head["version"]
    if last is None or last > current or (forced and last == current):
        return FeedRead(table.contents(head), current, full=True)
    if last == current:
        return FeedRead(None, None)
    try:
        rows = ch.version_range(table.changes(last, current), last, current, deletes)
    except FeedError:
        return FeedRead(table.contents(head), current, full=True)
    keys = head["merge_keys"] if keys is None else keys
    if keys:
        rows = ch.latest_changes(rows, keys)
    return FeedRead(rows if deletes else ch.without_commit_columns(rows), current)
