"""The Parquet tables of one installation and how a run publishes to them.

Every run writes only folders carrying its run id, replacing what an earlier attempt of the same
run left there. Its finish row in the ledger is the only commit: whatever a run wrote counts, for
the sources that finished, from that row on. Landed rows are the exception. They count from the
landed event on, and wait for a run that loads them.

A finish row carries where its source stands from then on: the run that last wrote each bucket, the
run whose folder holds the rows that could not be loaded, and the runs whose landed rows it took
over. So one pass over the ledger tells a run which folders to open, and it opens only these.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ledger import FINISHED, LANDED, SOURCE, current_runs, fold_checkpoints
from millrace.operators.normalize import normalize
from millrace.operators.validate import rejected, validate
from millrace.schemas import ITEMS, LEDGER, PROCESSED, RAW, REJECTS
from millrace.session import local_rows

EVENTS = T.StructType(
    [
        *LEDGER.fields,
        # Orders the runs of a source by when they were loaded.
        T.StructField("seq", T.LongType()),
        T.StructField("versions", T.MapType(T.IntegerType(), T.StringType())),
        T.StructField("open_run", T.StringType()),
        T.StructField("taken", T.ArrayType(T.StringType())),
    ]
)
SLICE = (*SOURCE, "bucket")

#: Fixed: characters that Spark writes as ``%`` and their code in the name of a partition folder.
ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^") | {chr(code) for code in range(1, 32)}


def folder(column: str, value: object) -> str:
    """The partition folder of a value."""
    text = "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in str(value))
    return f"{column}={text}"


@dataclass(frozen=True)
class SourceState:
    """What the ledger says of a source: its mark, its last load, and runs whose rows wait to be loaded."""

    mark: str | None
    seq: int
    versions: dict[int, str]
    open_run: str | None
    pending: tuple[str, ...]
    #: Whether the run asked about has finished for this source.
    done: bool


UNKNOWN = SourceState(None, 0, {}, None, (), False)


@dataclass(frozen=True)
class Store:
    """``buckets`` cuts the items of a source by key; a run rewrites only the buckets it touches.

    Choose it once, so that one bucket of the largest source is a comfortable amount to rewrite.
    """

    root: str
    buckets: int = 1

    def with_bucket(self, items: DataFrame) -> DataFrame:
        hashed = F.pmod(F.xxhash64("external_id"), F.lit(self.buckets))
        return items.withColumn("bucket", hashed.cast("int"))

    def _read(
        self, spark: SparkSession, table: str, schema: T.StructType, folders: Iterable[str] | None = None
    ) -> DataFrame:
        """A table, or only the given folders of it, which exist: then nothing else is listed."""
        root = f"{self.root}/{table}"
        paths = [root] if folders is None else [f"{root}/{one}" for one in folders]
        if not paths:
            return local_rows(spark, [], schema)
        try:
            return spark.read.schema(schema).option("basePath", root).parquet(*paths)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return local_rows(spark, [], schema)
            raise

    def check_layout(self, spark: SparkSession) -> None:
        """Refuse another number of buckets than the one the items were written with."""
        known = self._read(spark, "layout", T.StructType([T.StructField("buckets", T.IntegerType())]))
        found = {row.buckets for row in known.collect()}
        if not found:
            one = local_rows(spark, [(self.buckets,)], "buckets int").coalesce(1)
            one.write.mode("overwrite").parquet(f"{self.root}/layout")
        elif found != {self.buckets}:
            raise ValueError(f"the items are cut into {found.pop()} buckets, not {self.buckets}")

    def raw(self, spark: SparkSession) -> DataFrame:
        """The rows of all runs that have landed; what a run left that died while landing does not count."""
        landed = self.ledger(spark).filter(F.col("event_seq") == LANDED).select(F.col("run_id").alias("etl_run_id"))
        return self._read(spark, "raw", RAW).join(landed.distinct(), "etl_run_id", "left_semi").select(*RAW.names)

    def raw_of(self, spark: SparkSession, pending: Sequence[tuple[str, str, str]]) -> DataFrame:
        """The rows of these runs and sources (run, kind, name); no folder of another run is opened."""
        runs = sorted({run for run, *_ in pending})
        rows = self._read(spark, "raw", RAW, [folder("etl_run_id", run) for run in runs])
        if not pending:
            return rows
        named = local_rows(spark, pending, "etl_run_id string, source_type string, source_name string")
        return rows.join(F.broadcast(named), ["etl_run_id", *SOURCE], "left_semi").select(*RAW.names)

    def _checked(self, spark: SparkSession, refused: bool) -> DataFrame:
        """The checked rows of all runs and sources that finished."""
        checked = validate(normalize(local_rows(spark, [], RAW))).schema
        more = "refused boolean, checked_at timestamp, run_id string"
        schema = T.StructType([*checked.fields, *local_rows(spark, [], more).schema.fields])
        rows = self._read(spark, "checked", schema).filter(F.col("refused") == refused)
        return rows.join(self.committed(spark), ["run_id", *SOURCE], "left_semi")

    def processed(self, spark: SparkSession) -> DataFrame:
        """What has been loaded: rows, by which run and when."""
        rows = self._checked(spark, refused=False)
        named = {"raw_id": "raw_data_id", "processed_at": "checked_at"}
        return rows.select(*(F.col(named.get(name, name)).alias(name) for name in PROCESSED.names))

    def rejects(self, spark: SparkSession) -> DataFrame:
        """What could not be loaded, one row per run that tried."""
        rows = self._checked(spark, refused=True).withColumn("etl_run_id", F.col("run_id"))
        return rejected(rows, F.col("checked_at")).select(*REJECTS.names)

    def _events(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "ledger", EVENTS)

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self._events(spark).select(*LEDGER.names)

    def landed(self, spark: SparkSession, run_id: str) -> DataFrame:
        """The landed event of one run."""
        at = [f"{folder('run_id', run_id)}/{folder('event_seq', LANDED)}"]
        return self._read(spark, "ledger", EVENTS, at).select(*LEDGER.names)

    def runs(self, spark: SparkSession) -> DataFrame:
        return current_runs(self.ledger(spark))

    def checkpoints(self, spark: SparkSession) -> DataFrame:
        return fold_checkpoints(self.ledger(spark))

    def committed(self, spark: SparkSession) -> DataFrame:
        """Runs and sources (``run_id``, ``source_type``, ``source_name``) that finished."""
        done = (F.col("event_seq") == FINISHED) & (F.col("status") != "failed")
        return self.ledger(spark).filter(done).select("run_id", *SOURCE).distinct()

    def states(self, spark: SparkSession, run_id: str = "") -> dict[tuple[str, str], SourceState]:
        """Where every source stands, in one pass over the ledger; the mark is the one before ``run_id``."""
        event, marked = F.col("event_seq"), F.col("checkpoint_after")
        done = (event == FINISHED) & (F.col("status") != "failed")
        runs = self._events(spark).groupBy("run_id", *SOURCE).agg(
            F.max_by("started_at", event).alias("started_at"),
            F.max_by(marked, F.when(marked.isNotNull(), event)).alias("mark"),
            F.bool_or((event == LANDED) & (F.col("records_extracted") > 0)).alias("landed"),
            F.bool_or(done).alias("done"),
            F.max_by(F.struct("seq", "versions", "open_run", "taken"), F.when(done, event)).alias("at"),
        )
        run, seq = F.col("run_id"), F.col("at.seq")
        counts = (run != run_id) & (F.coalesce("mark", F.lit("")) != "")
        folded = runs.groupBy(*SOURCE).agg(
            F.max_by("mark", F.when(counts, F.struct("started_at", "run_id"))).alias("mark"),
            F.max_by("at", seq).alias("last"),
            F.array_except(
                F.collect_set(F.when(F.col("landed") & ~F.col("done"), run)),
                F.flatten(F.collect_list("at.taken")),
            ).alias("pending"),
            F.coalesce(F.bool_or((run == run_id) & F.col("done")), F.lit(False)).alias("done"),
        )
        # One row per source.
        found = {}
        for row in folded.collect():
            last = row.last or (0, {}, None, [])
            found[row.source_type, row.source_name] = SourceState(
                row.mark, last[0] or 0, dict(last[1] or {}), last[2], tuple(sorted(row.pending)), row.done
            )
        return found

    def slices(self, spark: SparkSession, versions: Iterable[tuple[str, str, int, str]]) -> DataFrame:
        """The items of these slices (kind, name, bucket, run); no other folder is opened."""
        folders = [
            "/".join([folder("version", run), folder("source_type", kind), folder("source_name", name), folder("bucket", bucket)])
            for kind, name, bucket, run in versions
        ]
        parts = [T.StructField("bucket", T.IntegerType()), T.StructField("version", T.StringType())]
        return self._read(spark, "items", T.StructType([*ITEMS.fields, *parts]), folders).select(*ITEMS.names)

    def items(self, spark: SparkSession) -> DataFrame:
        """The current items: of every source and bucket, what its last loading run published."""
        return self.slices(
            spark,
            [(*source, bucket, run) for source, state in self.states(spark).items() for bucket, run in state.versions.items()],
        )

    def open_of(self, spark: SparkSession, sources: Iterable[tuple[str, str, str]]) -> DataFrame:
        """Raw rows that sources could not load, from the folder of the run given with each (kind, name, run)."""
        folders = [
            "/".join([folder("run_id", run), folder("source_type", kind), folder("source_name", name)])
            for kind, name, run in sources
        ]
        schema = T.StructType([*RAW.fields, T.StructField("run_id", T.StringType())])
        return self._read(spark, "open", schema, folders).select(*RAW.names)

    def open_rows(self, spark: SparkSession, sources: DataFrame) -> DataFrame:
        """Raw rows of these sources that their last load could not accept; earlier runs are not read."""
        states = self.states(spark)
        named = [(*row, states.get(tuple(row), UNKNOWN).open_run) for row in sources.select(*SOURCE).collect()]
        return self.open_of(spark, [one for one in named if one[2]])

    def pending(self, spark: SparkSession, sources: DataFrame) -> DataFrame:
        """Runs (``etl_run_id``) and sources that landed rows which no finished run has taken over."""
        states = self.states(spark)
        rows = [(run, *row) for row in sources.select(*SOURCE).collect() for run in states.get(tuple(row), UNKNOWN).pending]
        return local_rows(spark, rows, "etl_run_id string, source_type string, source_name string")

    def write_run(
        self, rows: DataFrame, table: str, run_id: str, partition_by: Sequence[str] = (), mode: str = "overwrite"
    ) -> str:
        """Write one run's rows of a table, replacing those of an earlier attempt."""
        column = {"raw": "etl_run_id", "items": "version"}.get(table, "run_id")
        path = f"{self.root}/{table}/{folder(column, run_id)}"
        rows.drop(column).write.mode(mode).partitionBy(*partition_by).parquet(path)
        return path

    def append_ledger(self, rows: DataFrame, run_id: str, event: int) -> None:
        path = f"{self.root}/ledger/{folder('run_id', run_id)}/{folder('event_seq', event)}"
        # A handful of rows, one per source.
        missing = {f.name: F.lit(None).cast(f.dataType) for f in EVENTS.fields if f.name not in rows.columns}
        events = rows.withColumns(missing).select(*EVENTS.names)
        events.drop("run_id", "event_seq").coalesce(1).write.mode("overwrite").parquet(path)
