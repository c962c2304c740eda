"""Span table and versioned state tables on any Hadoop file system."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan import schemas
from veilspan.operators.spans import dedupe_latest, with_hot_columns

STATE_SCHEMAS = {
    "tenants": schemas.TENANTS, "api_keys": schemas.API_KEYS,
    "redaction_policies": schemas.POLICIES, "audit_events": schemas.AUDIT,
    "tenant_retention": schemas.RETENTION, "ledger_open": schemas.LEDGER,
    "ledger_settled": schemas.LEDGER, "traces_open": schemas.TAIL_TRACES,
    "traces_closed": schemas.TAIL_TRACES, "tail_buffers": schemas.TAIL_BUFFERS,
    "tail_event_keys": schemas.TAIL_EVENT_KEYS, "tail_decisions": schemas.TAIL_DECISIONS,
    "outbox_pending": schemas.TAIL_OUTBOX, "outbox_published": schemas.TAIL_OUTBOX,
}

# Span table columns: the logical row, the promoted report columns and the date partition.
STORED_SPANS = T.StructType(
    schemas.SPANS.fields
    + [T.StructField("service_name", T.StringType()), T.StructField("peer_service", T.StringType()),
       T.StructField("usage_error", T.BooleanType()), T.StructField("ingest_date", T.DateType())])


def write_spans(rows: DataFrame, path: str, mode: str = "append", replace_partitions: bool = False) -> None:
    """Append span rows, partitioned by tenant and arrival date.

    ``replace_partitions`` puts the rows in place of the partitions they fall into; others stay.

    The rebalance lets AQE merge small and split large partitions, so one dominant tenant
    neither becomes one task nor a flood of small files.  Files are in order of the event key, which
    begins with the trace for spans; that and a Bloom filter on the trace let a lookup skip row groups.
    """
    ready = with_hot_columns(rows).withColumn("ingest_date", F.to_date("ingested_at"))
    if replace_partitions:
        mode = "overwrite"
    (ready.hint("rebalance", "tenant_id", "ingest_date")
     .sortWithinPartitions("tenant_id", "ingest_date", "event_key")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic" if replace_partitions else "static").partitionBy("tenant_id", "ingest_date")
     .option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path))


def scan_spans(spark: SparkSession, path: str, since=None) -> DataFrame:
    """All stored versions; ``since`` (a timestamp column or literal) prunes date partitions."""
    rows = spark.read.schema(STORED_SPANS).parquet(path)
    if since is not None:
        rows = rows.filter(F.col("ingest_date") >= F.to_date(since))
    return rows


def read_spans(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Current version per key, as logical span rows."""
    return dedupe_latest(scan_spans(spark, path, since).select(*schemas.SPANS.fieldNames()))


def drop_tenant_spans(spark: SparkSession, path: str, tenant: str) -> None:
    """Remove a tenant's stored spans: its partition folder, whatever its size."""
    if not tenant:
        raise ValueError("tenant required")
    _drop_folder(spark, path, tenant)


def drop_partition(spark: SparkSession, path: str, tenant: str, date) -> None:
    """Remove the stored spans of a tenant's arrival date."""
    _drop_folder(spark, path, tenant, f"/ingest_date={date.isoformat()}")


def _drop_folder(spark: SparkSession, path: str, tenant: str, below: str = "") -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        path, "tenant_id=" + spark._jvm.org.apache.spark.sql.catalyst.catalog
        .ExternalCatalogUtils.escapePathName(tenant) + below)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables whose rows are looked up by later batches but only ever added, and the time that dates them.
DAY_TABLES = {"tail_event_keys": "created_at", "traces_closed": "decided_at"}
#: After so many versions the open days of these tables are written anew, as few files.
MERGE_EVERY = 16


class StateStore:
    """Versioned tables that change together.

    Each table is a list of Parquet folders, ``<version>-full`` or ``<version>-add``; it reads
    as its newest full folder plus later additions.  A version becomes visible, for all tables
    at once, when its marker file is created; folders of a version without a marker are
    ignored, and removed by the retry.  A store has one writer at a time.  Settled rows (decided traces, published and
    persisted rows, seen keys) are only ever added, so a batch writes in proportion to itself
    and to the open rows, not to the history.

    Tables of ``DAY_TABLES`` are one folder partitioned by day.  Their rows carry the version that
    added them, so those of a version that was not published are not seen.  Reading may be bounded to
    days, and the newest days are written anew every ``MERGE_EVERY`` versions, so the files that a
    batch reads depend on the days it asks for and not on the number of batches before it.
    """

    def __init__(self, spark: SparkSession, root: str,
                 table_schemas: Mapping[str, T.StructType] = STATE_SCHEMAS):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(table_schemas)

    # -- file system ----------------------------------------------------------------
    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, fs = self._path(*parts)
        if not fs.exists(path):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(path))

    # -- versions -------------------------------------------------------------------
    def version(self) -> int:
        """Newest published version, -1 before the first."""
        markers = self._names("_commits")
        return int(markers[-1].split("-")[0]) if markers else -1

    def epoch(self) -> int:
        """Newest stream batch that was taken in, -1 before the first."""
        return max((int(m.split("-")[1]) for m in self._names("_commits") if "-" in m),
                   default=-1)

    def begin(self) -> int:
        """The next version to write; leftovers of a failed attempt at it are removed."""
        version = self.version() + 1
        path, fs = self._path("_begun", f"{version:012d}")
        fs.mkdirs(path.getParent())
        failed = not fs.createNewFile(path)
        for name in self.schemas:
            for folder in self._names(name):
                if int(folder.split("-")[0]) >= version:
                    path, fs = self._path(name, folder)
                    fs.delete(path, True)
        for name in DAY_TABLES.keys() & self.schemas.keys() if failed else ():
            left = self._dated(name)
            if left is not None:
                self._rewrite(name, left.filter(F.col("version") >= version), F.col("version") < version)
        return version

    def _folders(self, name: str, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        entries = [(int(f.split("-")[0]), f.split("-")[1], f) for f in self._names(name)]
        seen = [e for e in entries if e[0] <= version]
        base = max((v for v, kind, _ in seen if kind == "full"), default=-1)
        return [f for v, kind, f in seen if v > base or (v == base and kind == "full")]

    # -- tables by day ----------------------------------------------------------------
    def _dated(self, name: str) -> DataFrame | None:
        """All rows of a table by day, with ``version`` and ``day``, or None before the first."""
        folders = self._folders(name)
        if not folders:
            return None
        schema = T.StructType([*self.schemas[name].fields, T.StructField("version", T.LongType()),
                               T.StructField("day", T.DateType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{folders[-1]}")

    def read_days(self, name: str, first=None, last=None) -> DataFrame:
        """Published rows of a table by day, of the given days (dates, bounds included)."""
        rows = self._dated(name)
        if rows is None:
            return self.spark.createDataFrame([], self.schemas[name])
        rows = rows.filter(F.col("version") <= self.version())
        if first is not None:
            rows = rows.filter(F.col("day") >= F.lit(first))
        if last is not None:
            rows = rows.filter(F.col("day") <= F.lit(last))
        return rows.select(*self.schemas[name].fieldNames())

    def _write_days(self, version: int, name: str, rows: DataFrame, full: bool) -> None:
        folders = self._folders(name)
        folder = f"{version:012d}-full" if full or not folders else folders[-1]
        dated = rows.withColumns({"version": F.lit(version).cast("long"),
                                  "day": F.coalesce(F.to_date(DAY_TABLES[name]), F.lit("1970-01-01").cast("date"))})
        # A full folder holds nothing but this version; otherwise files are added.
        (dated.hint("rebalance", "day").write.mode("overwrite" if full else "append")
         .partitionBy("day").parquet(f"{self.root}/{name}/{folder}"))

    def _rewrite(self, name: str, which: DataFrame, keep) -> None:
        """Write the days of ``which`` anew, of their rows those that ``keep`` says; other days keep their files."""
        days = [r["day"] for r in which.select("day").distinct().collect()]  # a few dates
        for day in days:
            rows = self._dated(name).filter((F.col("day") == F.lit(day)) & keep)
            target = f"{self.root}/{name}/{self._folders(name)[-1]}"
            if rows.isEmpty():
                path, fs = self._path(name, self._folders(name)[-1], f"day={day}")
                fs.delete(path, True)
            else:
                (rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("day").parquet(target))

    def merge_days(self, name: str, first) -> None:
        """Write the days from ``first`` on as few files.

        Spark replaces a day by moving the new files in after the old ones are gone, so the driver must
        not be stopped in between; lost executors do no harm.
        """
        rows = self._dated(name)
        if rows is not None:
            self._rewrite(name, rows.filter(F.col("day") >= F.lit(first)), F.col("version") <= self.version())

    def read(self, name: str) -> DataFrame:
        if name in DAY_TABLES:
            return self.read_days(name)
        schema = self.schemas[name]
        folders = self._folders(name)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(
            *[f"{self.root}/{name}/{folder}" for folder in folders])

    def write(self, version: int, name: str, rows: DataFrame, full: bool) -> None:
        """Write one table's folder of a version that is not committed yet."""
        kind = "full" if full else "add"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]]
        if name in DAY_TABLES:
            self._write_days(version, name, rows.select(*columns), full)
            return
        rows.select(*columns).write.mode("overwrite").parquet(
            f"{self.root}/{name}/{version:012d}-{kind}")

    def publish(self, version: int, epoch: int | None = None) -> None:
        """Make a version visible; ``epoch`` records that a stream batch is done."""
        marker = f"{version:012d}" + ("" if epoch is None else f"-{epoch:012d}")
        path, fs = self._path("_commits", marker)
        fs.mkdirs(path.getParent())
        if not fs.createNewFile(path):
            raise OSError("state version is already published")
        # Only the newest markers say anything: that of the version, and that of the newest batch.
        markers = self._names("_commits")
        batches = [m for m in markers if "-" in m]
        for folder, names in (("_commits", set(markers[:-2]) - set(batches[-1:])), ("_begun", self._names("_begun")[:-2])):
            for name in names:
                old, fs = self._path(folder, name)
                fs.delete(old, False)

    def commit(self, replace: Mapping[str, DataFrame] | None = None,
               append: Mapping[str, DataFrame] | None = None) -> None:
        """Write and publish one version."""
        version = self.begin()
        for name, rows in (replace or {}).items():
            self.write(version, name, rows, full=True)
        for name, rows in (append or {}).items():
            self.write(version, name, rows, full=False)
        self.publish(version)

    def pending(self, name: str, version: int, full: bool) -> DataFrame:
        """Read back a folder written for a version that is not published yet.

        Later tables of the same version are derived from what was written, not computed
        again, which also cuts the lineage without relying on any executor.
        """
        if name in DAY_TABLES:
            raise ValueError("tables by day are read when published")
        kind = "full" if full else "add"
        return self.spark.read.schema(self.schemas[name]).parquet(
            f"{self.root}/{name}/{version:012d}-{kind}")

    def scratch(self, name: str, number: int, rows: DataFrame) -> DataFrame:
        """Write rows that only one batch needs and read them back; those of earlier batches go."""
        path, fs = self._path("_scratch", name)
        fs.delete(path, True)
        target = f"{self.root}/_scratch/{name}/{number}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(rows.schema).parquet(target)

    def vacuum(self) -> None:
        """Remove folders that no longer take part in the current version."""
        current = self.version()
        for name in self.schemas:
            live = set(self._folders(name, current))
            for folder in self._names(name):
                if folder not in live and int(folder.split("-")[0]) <= current:
                    path, fs = self._path(name, folder)
                    fs.delete(path, True)


def read_meta(store: StateStore, name: str) -> DataFrame:
    return store.read(name)


def write_meta(store: StateStore, name: str, rows: DataFrame) -> None:
    """Replace one table in a version of its own."""
    store.commit(replace={name: rows})


def cut_in(folder: str):
    """A ``cut`` for :func:`veilspan.operators.staging.stage` that writes below ``folder``."""
    def cut(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return cut
