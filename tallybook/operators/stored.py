"""Keyed tables that lie in buckets of their key, so that an upsert shuffles the incoming rows alone."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import field, quoted
from tallybook.operators.tables import latest_per_key, merged_rows
from tallybook.sources.splits import write_split

_SPEC = "version long, rows string, key string, buckets int, schema string"


@dataclass(frozen=True)
class StoredTable:
    """One version of a keyed table under ``root``.

    Rows with a key lie in ``buckets`` files by the hash of it (``rows``), each key once; rows without key lie beside them by the version
    that brought them, as they meet nothing.  A version is complete when its line stands in ``root/versions``: what a failed run
    left behind is never read, and older versions stay readable.  One writer at a time.
    """

    spark: SparkSession
    root: str
    version: int
    rows: str
    key: str
    buckets: int
    schema: T.StructType

    def keyed(self) -> DataFrame:
        """Rows with a key, as a scan that Spark knows to be dealt out by it."""
        name = _name(self.rows)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted(self.key)}) INTO {self.buckets} BUCKETS LOCATION '{self.rows}'")
        return self.spark.table(name)

    def keyless(self) -> DataFrame:
        place = "__version"
        schema = T.StructType([*self.schema.fields, T.StructField(place, T.LongType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/keyless").where(F.col(place) <= self.version).drop(place)

    def table(self) -> DataFrame:
        return self.keyed().unionByName(self.keyless())

    def merged(self, last: DataFrame, insert_only: Sequence[str] = ()) -> DataFrame:
        """The keyed rows after an upsert of ``last``, which holds each key once and no row without key.

        The stored rows are neither shuffled nor grouped: ``last`` is dealt out as they are.
        """
        return merged_rows(self.keyed(), _dealt(last, self.key, self.buckets), self.key, insert_only, all_keyed=True)

    def upsert(self, incoming: DataFrame, order: Sequence[str] = (), insert_only: Sequence[str] = ()) -> StoredTable:
        """The next version: as ``tables.upsert`` of ``incoming`` onto this one.

        ``incoming`` is computed once.  Columns that the table has keep its types; new columns are added.
        """
        kinds = {f.name: f.dataType for f in self.schema.fields}
        fitted = incoming.select(*[field(c).cast(kinds[c]).alias(c) if c in kinds else field(c) for c in incoming.columns])
        keyed, keyless = _parted(fitted, self.key, f"{self.root}/incoming-{uuid.uuid4().hex}")
        after = self.merged(latest_per_key(keyed, [self.key], order), insert_only)
        return _stored(after, keyless, self.root, self.version + 1, self.key, self.buckets)


def store(df: DataFrame, root: str, key: str, buckets: int | None = None, order: Sequence[str] = ()) -> StoredTable:
    """The first version of a table: of several rows with one key the last by ``order``, and every row without key.

    ``buckets`` is the number of files and of tasks of each later upsert, by default that of shuffle partitions: at 100 TB
    one that makes files of a few hundred MB.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed, keyless = _parted(df, key, f"{root}/incoming-{uuid.uuid4().hex}")
    return _stored(_dealt(latest_per_key(keyed, [key], order), key, buckets), keyless, root, 0, key, buckets)


def open_stored(spark: SparkSession, root: str, version: int | None = None) -> StoredTable | None:
    """The newest version, or a given one; None where there is none."""
    try:
        known = spark.read.schema(_SPEC).json(f"{root}/versions")
    except AnalysisException:
        return None
    known = known if version is None else known.where(F.col("version") == version)
    found = known.orderBy(F.desc("version")).first()
    if found is None:
        return None
    return StoredTable(spark, root, found["version"], found["rows"], found["key"], found["buckets"], T.StructType.fromJson(json.loads(found["schema"])))


def _dealt(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows dealt out as the buckets are; grouping by key does so where there are as many buckets as shuffle partitions."""
    same = buckets == int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if same else df.repartition(buckets, field(key))


def _name(path: str) -> str:
    return "stored_" + hashlib.md5(path.encode()).hexdigest()


def _parted(df: DataFrame, key: str, path: str) -> tuple[DataFrame, DataFrame]:
    verdict = "__verdict"
    split = write_split(df.withColumn(verdict, F.when(field(key).isNull(), "keyless").otherwise("keyed")), path, verdict)
    return split.part("keyed"), split.part("keyless")


def _stored(keyed: DataFrame, keyless: DataFrame, root: str, version: int, key: str, buckets: int) -> StoredTable:
    spark = keyed.sparkSession
    rows = f"{root}/rows-{version}-{uuid.uuid4().hex}"
    keyed.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", rows).saveAsTable(_name(rows))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in keyed.schema.fields])
    kinds = {f.name: f.dataType for f in schema.fields}
    keyless.select(*[field(c).cast(kinds[c]).alias(c) for c in keyless.columns]).write.mode("overwrite").parquet(f"{root}/keyless/__version={version}")
    line = spark.createDataFrame([(version, rows, key, buckets, schema.json())], _SPEC)
    line.coalesce(1).write.mode("append").json(f"{root}/versions")
    return StoredTable(spark, root, version, rows, key, buckets, schema)
