"""Tables of committed batches, and the current state derived from them.

A batch writes each of its frames into a folder of its own and then one row into ``commits``. Readers
look only at committed batches, so a batch is visible as a whole or not at all, and a replay replaces
its own folders. ``compact`` folds older batches into a base so that reading the current state stays
proportional to the state, not to its history.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillflow.schemas import (
    COMMITS, EVENT_SCHEMA_VERSION, LAYOUT_VERSION, PRIMARY_KEYS, SIDE_KEYS, SIDE_TABLES, TABLES, columns,
)

_BATCH = columns("stream_id string, batch_id bigint")
_SCHEMAS, _KEYS = TABLES | SIDE_TABLES, PRIMARY_KEYS | SIDE_KEYS
# The column that lays out a base, so that readers of some of its values leave the rest unread.
LAID_OUT = {"deliveries": "status"}
_MANIFEST = "table_name string, path string, version bigint, row_count bigint"
# Core columns without which an old table cannot be upgraded.
LEGACY_CORE = ("id", "source", "kind", "content", "url", "created_at", "collected_at", "metadata_json")


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    target, fs = _hadoop_path(spark, path)
    return bool(fs.exists(target))


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    src, fs = _hadoop_path(spark, source)
    if not fs.rename(src, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def delete_path(spark: SparkSession, path: str) -> None:
    target, fs = _hadoop_path(spark, path)
    fs.delete(target, True)


def create_path(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if there is one. The file system decides between two who try."""
    target, fs = _hadoop_path(spark, path)
    fs.mkdirs(target.getParent())
    try:
        fs.create(target, False).close()
    except Py4JJavaError as error:
        if fs.exists(target):
            return False
        raise error
    return True


# Shuffle files go with the write that made them; else they stay until the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_files(frame: DataFrame, path: str, mode: str = "errorifexists", by: Sequence[str] = ()) -> None:
    """Write Parquet files that take little room: ids and hashes are hex digits, which only an entropy code halves."""
    conf = frame.sparkSession.conf
    before = conf.get(_TIDY, None)
    conf.set(_TIDY, "true")
    try:
        frame.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(_TIDY) if before is None else conf.set(_TIDY, before)


class Conflict(RuntimeError):
    """Another batch was committed after the state that a batch was derived from."""


def check_version(version: int) -> None:
    """Refuse tables of a layout newer than this code, before anything is written."""
    if version > LAYOUT_VERSION:
        raise ValueError(
            f"table layout version {version} is newer than supported version {LAYOUT_VERSION}"
        )


class Store:
    """A folder of tables with any number of committers and readers.

    Every commit claims the next free ``version`` by creating a file of that name, so no two share one; of
    two rows of a key the one with the higher version wins, then the one with the higher ``order`` columns.
    """

    def __init__(self, spark: SparkSession, root: str, version: int = LAYOUT_VERSION) -> None:
        check_version(version)
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str, stream_id: str | None = None, batch_id: int | None = None) -> str:
        if stream_id is None:
            return f"{self.root}/{table}"
        return f"{self.root}/{table}/stream_id={stream_id}/batch_id={batch_id}"

    def write(self, table: str, stream_id: str, batch_id: int, frame: DataFrame) -> None:
        """Write one table of a batch; a replay replaces what an earlier try left, even when empty."""
        write_files(frame, self.path(table, stream_id, batch_id), "overwrite")

    def drop(self, table: str, stream_id: str, batch_id: int) -> None:
        """Remove a table that only its own batch reads; a replay writes it again."""
        delete_path(self.spark, self.path(table, stream_id, batch_id))

    def read_batch(self, table: str, schema: T.StructType, stream_id: str, batch_id: int) -> DataFrame:
        """What :meth:`write` stored, committed or not: the rest of a batch is derived from it."""
        return self.spark.read.schema(schema).parquet(self.path(table, stream_id, batch_id))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return self.commits().agg(F.coalesce(F.max("version"), F.lit(0)).cast("bigint")).head()[0]

    def commit(
        self, stream_id: str, batch_id: int, frames: Mapping[str, DataFrame] | None = None, after: int | None = None
    ) -> int:
        """Write the frames, if any, then make the whole batch visible; returns its version.

        ``after`` is the version the batch was derived from: where another batch has claimed one since,
        nothing is committed and :class:`Conflict` is raised.
        """
        for table, frame in (frames or {}).items():
            self.write(table, stream_id, batch_id, frame)
        done = self.commits().filter(
            (F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)
        ).head(1)
        if done:
            return done[0]["version"]
        version = (self.version() if after is None else after) + 1
        while not create_path(self.spark, f"{self.path('claims')}/version={version}"):
            if after is not None:
                raise Conflict(f"version {version} is taken")
            version += 1
        row = self.spark.range(1).select(
            F.lit(stream_id).alias("stream_id"), F.lit(batch_id).cast("bigint").alias("batch_id"),
            F.lit(version).cast("bigint").alias("version"), F.current_timestamp().alias("committed_at"),
        )
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path('commits')}/commit={stream_id}-{batch_id}")
        return version

    def commits(self) -> DataFrame:
        if not path_exists(self.spark, self.path("commits")):
            return self.spark.createDataFrame([], COMMITS)
        return self.spark.read.schema(COMMITS).parquet(f"{self.path('commits')}/*")

    def is_committed(self, stream_id: str, batch_id: int) -> bool:
        return path_exists(self.spark, f"{self.path('commits')}/commit={stream_id}-{batch_id}")

    def log(self, table: str, schema: T.StructType, after: int = 0, as_of: int | None = None) -> DataFrame:
        """Committed rows of a table with their ``version``, those after a version and up to ``as_of`` only.

        The commits are one small row per batch; joined on the folder columns they prune the scan.
        """
        if not path_exists(self.spark, self.path(table)):
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("version", T.LongType())]))
        full = T.StructType([*schema.fields, *_BATCH.fields])
        rows = self.spark.read.schema(full).parquet(self.path(table))
        done = self.commits().filter(F.col("version") > after).select("stream_id", "batch_id", "version")
        if as_of is not None:
            done = done.filter(F.col("version") <= as_of)
        return rows.join(done, ["stream_id", "batch_id"]).select(*schema.fieldNames(), "version")

    def _base(self, table: str, as_of: int | None = None) -> tuple[str, int] | None:
        """The newest base of a table that reaches no further than ``as_of``: its folder and its version."""
        marks = f"{self.path('bases')}/{table}"
        if not path_exists(self.spark, marks):
            return None
        found = self.spark.read.parquet(f"{marks}/*")
        newest = (found if as_of is None else found.filter(F.col("version") <= as_of)).orderBy(F.desc("version")).head(1)
        return (newest[0]["path"], newest[0]["version"]) if newest else None

    def current(
        self,
        table: str,
        order: Sequence[str] = (),
        names: Sequence[str] | None = None,
        only: DataFrame | None = None,
        among: Sequence[str] | None = None,
        as_of: int | None = None,
    ) -> DataFrame:
        """The last committed row per primary key, from the newest base and the commits after it.

        ``as_of`` gives the state at that version, whatever is committed meanwhile. ``among`` keeps rows with these values of
        the column that lays out the table; of the base, only their folders are read. A row that
        has moved to or from one of them since stands in the commits, which are read in any case.

        ``names`` limits the columns that are read, ``only`` the keys: a small frame of keys, or of some of the key
        columns, filters both scans before anything is shuffled. Filters on key columns reach the scans by themselves.
        """
        schema, keys = _SCHEMAS[table], _KEYS[table]
        laid = LAID_OUT.get(table)
        if among is not None and laid is None:
            raise ValueError(f"{table} is not laid out by a column")
        must = keys if among is None else (*keys, laid)
        wanted = [f for f in schema.fields if names is None or f.name in names or f.name in must]
        logged = T.StructType([*wanted, *[T.StructField(c, T.LongType()) for c in order]])
        base = self._base(table, as_of)
        rows = self.log(table, logged, base[1] if base else 0, as_of)
        if base is not None:
            old = self.spark.read.schema(T.StructType(wanted)).parquet(base[0])
            if among is not None:
                old = old.filter(F.col(laid).isin(*among))
            old = old.select(*[f.name for f in wanted]).withColumns(
                {c: F.lit(-1).cast("bigint") for c in ("version", *order)}
            )
            rows = rows.unionByName(old)
        if only is not None:
            on = [k for k in keys if k in only.columns]
            rows = rows.join(only.select(*on).distinct(), on, "left_semi")
        rest = [f.name for f in wanted if f.name not in keys]
        last = (
            rows.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct("version", *order)).alias("r"))
            .select(*[f"r.{f.name}" if f.name in rest else f.name for f in wanted])
        )
        return last if among is None else last.filter(F.col(laid).isin(*among))

    def compact(self, table: str, order: Sequence[str] = ()) -> int:
        """Write the current state as a new base; readers switch once its mark is there."""
        version, base = self.version(), self._base(table)
        if base is not None and base[1] >= version:
            return base[1]
        # Folders of their own: two who compact at once write the same rows and disturb neither each other nor readers.
        name = f"{version}-{uuid.uuid4().hex}"
        path = f"{self.path('base')}/{table}/version={name}"
        write_files(self.current(table, order, as_of=version), path, by=[LAID_OUT[table]] if table in LAID_OUT else ())
        self.spark.range(1).select(
            F.lit(path).alias("path"), F.lit(version).cast("bigint").alias("version")
        ).coalesce(1).write.parquet(f"{self.path('bases')}/{table}/mark={name}")
        return version

    def compact_after(self, table: str, versions: int, order: Sequence[str] = ()) -> bool:
        """Compact once so many versions have been committed since the base; bounds what readers take from the log."""
        base = self._base(table)
        due = self.version() - (base[1] if base else 0) >= versions
        if due:
            self.compact(table, order)
        return due


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-free hash of whole rows."""
    row = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("s"),
    )


def export_snapshot(
    spark: SparkSession, tables: Mapping[str, DataFrame], dest: str, overwrite: bool = False
) -> DataFrame:
    """Copy the given state to ``dest``; it appears there only after the copy was verified.

    Returns one row per table with its row count. An older snapshot survives any failure.
    """
    if path_exists(spark, dest) and not overwrite:
        raise FileExistsError(dest)
    staging = f"{dest.rstrip('/')}.staging"
    # What a crashed export left must not be published with this one.
    delete_path(spark, staging)
    report = []
    for name, df in tables.items():
        target = f"{staging}/{name}"
        df.write.mode("overwrite").parquet(target)
        want = table_digest(df).head()
        got = table_digest(spark.read.schema(df.schema).parquet(target)).head()
        if want != got:
            delete_path(spark, staging)
            raise RuntimeError(f"snapshot of {name} differs from its source")
        report.append((name, want["n"]))
    if path_exists(spark, dest):
        old = f"{dest.rstrip('/')}.old"
        rename_path(spark, dest, old)
        rename_path(spark, staging, dest)
        delete_path(spark, old)
    else:
        rename_path(spark, staging, dest)
    return spark.createDataFrame(report, "table_name string, row_count bigint")


def export_state(store: Store, dest: str, orders: Mapping[str, Sequence[str]], as_of: int | None = None) -> DataFrame:
    """Copy tables as of one version below ``dest`` while others commit; returns the manifest.

    ``orders`` names the tables with their order columns. Each copy is read back and compared with its source, into a folder
    of its own; the manifest, one file written last, publishes all of them at once. An older snapshot stays
    readable before, meanwhile and after, and a crash leaves it the newest one.
    """
    spark, version = store.spark, store.version() if as_of is None else as_of
    name = f"{version}-{uuid.uuid4().hex}"
    lines = []
    for table, order in orders.items():
        path = f"{dest.rstrip('/')}/data/{name}/{table}"
        state = store.current(table, order, as_of=version)
        state.write.parquet(path)
        want, got = table_digest(state).head(), table_digest(spark.read.schema(state.schema).parquet(path)).head()
        if want != got:
            raise RuntimeError(f"snapshot of {table} differs from its source")
        lines.append((table, path, version, want["n"]))
    manifest = spark.createDataFrame(lines, _MANIFEST)
    manifest.coalesce(1).write.parquet(f"{dest.rstrip('/')}/manifests/manifest={name}")
    return manifest


def exported(spark: SparkSession, dest: str, table: str, as_of: int | None = None) -> DataFrame:
    """A table of the newest published snapshot, or of the newest up to a version."""
    found = spark.read.schema(_MANIFEST).parquet(f"{dest.rstrip('/')}/manifests/*").filter(F.col("table_name") == table)
    chosen = (found if as_of is None else found.filter(F.col("version") <= as_of)).orderBy(F.desc("version"), "path").head()
    if chosen is None:
        raise FileNotFoundError(f"no snapshot of {table} in {dest}")
    return spark.read.schema(_SCHEMAS[table]).parquet(chosen["path"])


def upgrade_legacy(df: DataFrame) -> DataFrame:
    """Add what older signal tables lack; the empty hash makes the next write of a row an update."""
    missing = [c for c in LEGACY_CORE if c not in df.columns]
    if missing:
        raise ValueError(f"not a signal table; missing columns: {', '.join(missing)}")
    defaults = {
        "schema_version": F.lit(EVENT_SCHEMA_VERSION),
        "source_instance": F.lit("default"),
        "title": F.lit(None).cast("string"),
        "author": F.lit(None).cast("string"),
        "updated_at": F.lit(None).cast("timestamp"),
        "event_hash": F.lit(""),
    }
    added = {c: v for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(added) if added else df
