"""Structured Streaming: sources, running a user function, incremental upsert, quarantine."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tallybook.config import CollectionConfig, ReportDefinition, Rule
from tallybook.functions.text import field
from tallybook.operators.quality import judged, quarantine
from tallybook.operators.tables import latest_and_keyless, upsert
from tallybook.plans.collection import UNIQUE_ID, prepare_rows
from tallybook.plans.report import report_columns

DEFAULT_TRIGGER = {"processingTime": "30 seconds"}
ONCE = {"availableNow": True}
_BATCH = "__batch_id"
_PLACE, _STATE = "__place", "__state"
REPLAYED, RUNS = 4, 64
"""Batches of a run, and runs, whose places the log remembers: only a run's last batch can come again."""


def kafka_options(servers: str, topic: str, starting: str = "latest") -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }


def kafka_source(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest"
) -> DataFrame:
    """Kafka topic as a stream.  Needs Spark's Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, starting)).load()


def file_source(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    pattern: str = "*",
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Newly landed files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", pattern)
    if fmt == "csv":
        reader = reader.options(header=True, quote='"', escape='"')
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_stream(
    df: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    path: str | None = None,
    fmt: str = "console",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply a user function to a stream and start it with a checkpoint (every 30 s by default)."""
    writer = df.transform(fn).writeStream.format(fmt).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or DEFAULT_TRIGGER))
    return writer.start(path) if path else writer.start()


def run_of(spark: SparkSession) -> str:
    """Id of the running streaming query, which its checkpoint keeps; a new checkpoint has a new one."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "manual"


class ChangeTable:
    """Keyed table kept as a base plus the changes of each micro-batch.

    A micro-batch writes only its own rows, one per key, under one root into a folder named after its place in the order, so a
    batch costs what it brings and not the size of the table.  Reading is one scan of that root, pruned to the places behind the
    base, under the schema that the table declared with its newest batch: the plan is equally large after 4 and after 400
    batches.  ``compact`` folds the changes into a new base, ``clean`` removes what is folded.

    The log is one small file for each of these events, replaced as a whole: it names the base, the schema, the newest place, and the
    last batch of each run.  A replayed batch finds itself there and overwrites its own folder; a batch whose write did not reach
    the log takes the same place again.  One stream writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: Sequence[str] = ()) -> None:
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, list(order)

    def _state(self) -> dict:
        """The newest state: version, base, newest place, schema, and for each run its last batches and their places."""
        folder = f"{self.path}/log"
        try:
            rows = self.spark.read.schema("version long, state string").json(folder).orderBy(F.desc("version")).limit(1).collect()
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return json.loads(rows[0]["state"]) if rows else {"version": -1, "base": -1, "newest": -1, "schema": None, "runs": {}}

    def _save(self, state: dict) -> None:
        """Write the next state; states that are two behind it are removed."""
        state = state | {"version": state["version"] + 1}
        entry = self.spark.range(1).select(F.lit(state["version"]).cast("long").alias("version"), F.lit(json.dumps(state)).alias("state"))
        entry.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{_STATE}={state['version']}")
        self._remove(f"{self.path}/log/{_STATE}={state['version'] - 2}")

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        run, state = run_of(self.spark), self._state()
        known = state["runs"].get(run, {})
        place = known.get(str(batch_id), state["newest"] + 1)
        last = latest_and_keyless(rows, self.key, self.order)
        last.write.mode("overwrite").parquet(f"{self.path}/changes/{_PLACE}={place}")
        if str(batch_id) in known:
            return
        schema = merged_schema(state["schema"] and T.StructType.fromJson(state["schema"]), last.schema)
        recent = dict(sorted((known | {str(batch_id): place}).items(), key=lambda item: int(item[0]))[-REPLAYED:])
        runs = {r: b for r, b in state["runs"].items() if r != run} | {run: recent}
        self._save(state | {"newest": place, "schema": schema.jsonValue(), "runs": dict(list(runs.items())[-RUNS:])})

    def _changes_after(self, state: dict) -> DataFrame | None:
        """Rows of the batches behind the base with their place: one scan, pruned by place."""
        if state["newest"] <= state["base"]:
            return None
        schema = T.StructType([*T.StructType.fromJson(state["schema"]).fields, T.StructField(_PLACE, T.LongType())])
        found = self.spark.read.schema(schema).parquet(f"{self.path}/changes")
        return found.where((F.col(_PLACE) > state["base"]) & (F.col(_PLACE) <= state["newest"]))

    def current(self) -> DataFrame:
        """The table as of now."""
        state = self._state()
        base = self.spark.read.parquet(f"{self.path}/base/version={state['base']}") if state["base"] >= 0 else None
        changes = self._changes_after(state)
        if changes is None:
            if base is None:
                raise ValueError(f"no table at {self.path}")
            return base
        last = latest_and_keyless(changes, self.key, [_PLACE, *self.order]).drop(_PLACE)
        return last if base is None else upsert(base, last, self.key, unique=True)

    def compact(self) -> int:
        """Write the current state as a new base; returns its version (the place of the last batch it holds)."""
        state = self._state()
        if state["newest"] > state["base"]:
            self.current().write.mode("overwrite").parquet(f"{self.path}/base/version={state['newest']}")
            self._save(state | {"base": state["newest"]})
        return state["newest"]

    def clean(self) -> int:
        """Remove folded changes and older bases; returns the number of folders.  Nobody may read an older state meanwhile."""
        base = self._state()["base"]
        old = [f for f in self._folders("changes") if int(f.rsplit("=", 1)[1]) <= base]
        old += [f for f in self._folders("base") if int(f.rsplit("=", 1)[1]) < base]
        return sum(self._remove(f) for f in old)

    def _folders(self, name: str) -> list[str]:
        path, store = self._store(f"{self.path}/{name}")
        return [str(f.getPath()) for f in store.listStatus(path) if f.isDirectory()] if store.exists(path) else []

    def _remove(self, folder: str) -> bool:
        path, store = self._store(folder)
        return bool(store.delete(path, True))

    def _store(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())


def merged_schema(known: T.StructType | None, new: T.StructType) -> T.StructType:
    """Columns of both; a column keeps the type it was declared with."""
    fields = {f.name: f for f in [*(known.fields if known else []), *new.fields]} | {f.name: f for f in (known.fields if known else [])}
    for f in new.fields:
        if fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name!r} was {fields[f.name].dataType.simpleString()} and is {f.dataType.simpleString()} now")
    return T.StructType([T.StructField(f.name, f.dataType) for f in fields.values()])


def stream_upsert(
    df: DataFrame,
    path: str,
    config: CollectionConfig,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Clean arriving raw rows and upsert them, micro-batch by micro-batch, into a change table."""
    prepared = prepare_rows(df, config)
    ranks = [c for c in prepared.columns if c.startswith("__rank")]
    table = ChangeTable(df.sparkSession, path, UNIQUE_ID, ranks)
    return (
        prepared.writeStream.foreachBatch(table.write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def upserted(spark: SparkSession, path: str, config: CollectionConfig) -> DataFrame:
    """Current rows of a table kept by ``stream_upsert``."""
    ranks = [f"__rank{i}" for i in range(len(config.order))]
    return ChangeTable(spark, path, UNIQUE_ID, ranks).current().drop(*ranks)


def stream_report(df: DataFrame, definition: ReportDefinition) -> DataFrame:
    """Formulas, deltas and reasons on a stream of primary rows (stateless)."""
    return report_columns(df, definition)


def stream_quarantine(
    df: DataFrame,
    rules: Sequence[Rule],
    good_path: str,
    bad_path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Split a stream by quality rules into two tables, in folders by run and batch; a replayed batch overwrites itself."""

    def split(rows: DataFrame, batch_id: int) -> None:
        rows.persist()  # both sinks read the batch, which may come from a non-file source
        good, bad = quarantine(rows, rules)
        place = f"__run={run_of(df.sparkSession)}/{_BATCH}={batch_id}"
        good.write.mode("overwrite").parquet(f"{good_path}/{place}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/{place}")
        rows.unpersist()

    return (
        df.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def stream_split(
    df: DataFrame,
    rules: Sequence[Rule],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """``stream_quarantine`` with one write for each micro-batch: the batch is read once and nothing is cached.

    Both parts lie under one root, by verdict, run and batch; ``split_part`` reads one of them.  A replayed batch overwrites itself.
    """

    def split(rows: DataFrame, batch_id: int) -> None:
        place = f"__run={run_of(df.sparkSession)}/{_BATCH}={batch_id}"
        judged(rows, rules).write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/{place}")

    return (
        df.writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ONCE))
        .start()
    )


def split_part(spark: SparkSession, path: str, schema: T.StructType, verdict: str) -> DataFrame:
    """The ``good`` or ``bad`` rows that ``stream_split`` has written; bad ones with their ``failed_rules``."""
    rules = T.StructField("failed_rules", T.ArrayType(T.StringType()))
    places = [T.StructField("__run", T.StringType()), T.StructField(_BATCH, T.LongType()), T.StructField("verdict", T.StringType())]
    found = spark.read.schema(T.StructType([*schema.fields, rules, *places])).parquet(path).where(F.col("verdict") == verdict)
    return found.drop("__run", _BATCH, "verdict", *(["failed_rules"] if verdict == "good" else []))
