"""Files in and out: delimited text with fixed or inferred schema, other formats, appends."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.text import quoted

MEGABYTE = 2**20


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    encoding: str = "UTF-8",
    header: bool = True,
    multiline: bool = False,
    schema: T.StructType | str | None = None,
    malformed: str | None = None,
) -> DataFrame:
    """Header text file as text columns (or a given schema); ``"`` quotes and escapes.

    ``malformed`` names a column that takes the whole line of rows with too few or too many cells, or with
    cells that do not fit the schema; null for sound rows.  ``multiline=True`` allows line breaks in cells
    but keeps one file in one task.
    """
    reader = spark.read.options(
        sep=delimiter, encoding=encoding, header=header, multiLine=multiline, quote='"', escape='"'
    )
    if malformed is not None:
        if schema is None:
            schema = reader.csv(path).schema  # reads the header alone
        elif isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        schema = T.StructType([*schema.fields, T.StructField(malformed, T.StringType())])
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=malformed, columnPruning=False, enforceSchema=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_split_records(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    schema: T.StructType | str | None = None,
    malformed: str | None = None,
) -> DataFrame:
    """Header text file (UTF-8) whose quoted cells may hold line breaks, read by many tasks however large a file is.

    Lines are read as they lie in the splits of a file.  A line begins a record when the quotes before it are even in number: a
    prefix sum over the splits of a file (one small row each), then over the lines of a split.  Lines of one record are put
    together again, also across splits, and parsed by ``from_csv``.  Every quote opens or closes a cell or is doubled within
    one; a file with single quotes inside bare cells is for ``read_delimited``.  Rows are those of ``multiline=True``: line breaks
    inside cells become ``\\n``, blank lines are left out, ``malformed`` takes the text of records with too few or too many cells.
    """
    if schema is None:
        schema = read_delimited(spark, path, delimiter, multiline=True).schema  # reads the header alone
    elif isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    lines = spark.read.text(path).select("value", place.alias("at"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("at.file").orderBy("at.split").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("at").agg(F.sum("quotes").alias("all"), F.min("line").alias("first"))
    splits = splits.select("at", "first", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
    in_split = Window.partitionBy("at").orderBy("line")
    upto = in_split.rowsBetween(Window.unboundedPreceding, -1)
    read = lines.join(splits, "at").withColumn("open", (F.col("before") + F.coalesce(F.sum("quotes").over(upto), F.lit(0))) % 2 == 1)
    begins = F.when(~F.col("open"), F.col("line"))
    read = read.withColumn("record", F.last(begins, ignorenulls=True).over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    # Lines at the start of a split that go on with a record of an earlier split: its number is the last one before.
    last = read.groupBy("at").agg(F.max("record").alias("latest"))
    last = last.select("at", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    read = read.join(last, "at").select("at.file", "line", "value", "at.split", F.coalesce("record", "carried").alias("record"), ((F.col("at.split") == 0) & (F.col("line") == F.col("first"))).alias("lead"))
    ordered = F.array_sort(F.collect_list(F.struct("split", "line", "value")))
    records = read.groupBy("file", "record").agg(ordered.alias("lines"), F.bool_or("lead").alias("header"))
    text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
    bad = malformed or "__malformed"
    wanted = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    layout = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in wanted.fields)
    parsed = records.where(~F.col("header")).select(text.alias("text")).where(F.trim("text") != "").select(F.from_csv("text", layout, options).alias("row"))
    return parsed.select("row.*") if malformed else parsed.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def read_inferred(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    sampling_ratio: float = 1.0,
    infer: bool = True,
    multiline: bool = False,
    malformed: str | None = "_corrupt",
) -> DataFrame:
    """Delimited file with a schema inferred from all rows, or from ``sampling_ratio`` of them, or text columns.

    What happens depends on the arguments alone, never on the size of the file.  A row with a cell that
    does not fit the inferred type (one outside the sample) keeps its line in ``malformed``.
    """
    if not infer:
        return read_delimited(spark, path, delimiter, multiline=multiline, malformed=malformed)
    guess = spark.read.options(
        sep=delimiter, header=True, quote='"', escape='"', multiLine=multiline,
        inferSchema=True, samplingRatio=sampling_ratio,
    ).csv(path)
    return read_delimited(spark, path, delimiter, multiline=multiline, schema=guess.schema, malformed=malformed)


def read_any(
    spark: SparkSession, path: str, row_tag: str = "row", multiline: bool = False, malformed: str | None = None
) -> DataFrame:
    """Read a file by its extension: csv, tsv, txt, json, xml (also parquet)."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("csv", "tsv", "txt"):
        delimiter = "," if kind == "csv" else "\t"
        return read_delimited(spark, path, delimiter, multiline=multiline, malformed=malformed)
    if kind == "json":
        return spark.read.option("multiLine", multiline).json(path)
    if kind == "xml":
        return spark.read.option("rowTag", row_tag).xml(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no reader for {path!r}")


# Extensions of data files.
DATA_EXTENSIONS = ("csv", "tsv", "txt", "json", "xml", "xls", "xlsx")


def landing_manifest(
    spark: SparkSession, path: str, patterns: Sequence[str] = ("*",), max_mb: float | None = None
) -> DataFrame:
    """Landed data files matching a glob: path, name, type, bytes, time, and whether to take them.

    Only the listing is read, never the contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    listed = None
    for pattern in patterns:
        part = files.option("pathGlobFilter", pattern).load(path).drop("content")
        listed = part if listed is None else listed.union(part)
    name = F.substring_index("path", "/", -1)
    kind = F.lower(F.substring_index(name, ".", -1))
    within = F.lit(True) if max_mb is None else F.col("length") <= int(max_mb * MEGABYTE)
    return (
        listed.distinct()
        .where(kind.isin(*DATA_EXTENSIONS) & name.contains("."))
        .select(
            "path",
            name.alias("file_name"),
            kind.alias("file_type"),
            F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified_at"),
            within.alias("accepted"),
        )
    )


def append_evolving(df: DataFrame, path: str, known: T.StructType | None = None) -> DataFrame:
    """Append rows whose columns may be new; returns the whole table under the merged schema.

    Without ``known``, the schema of the table before, Spark reads the footers of all its files to merge them; with it none is
    read.  A column that comes with another type than the table's raises before anything is written.
    """
    if known is None:
        df.write.mode("append").parquet(path)
        return df.sparkSession.read.option("mergeSchema", True).parquet(path)
    kinds = {f.name: f.dataType for f in known.fields}
    other = [f.name for f in df.schema.fields if kinds.get(f.name, f.dataType) != f.dataType]
    if other:
        raise ValueError(f"columns {other} have another type in {path!r}")
    df.write.mode("append").parquet(path)
    fields = [*known.fields, *[f for f in df.schema.fields if f.name not in kinds]]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def write_summary(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a summary as JSON lines or header CSV."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
    elif fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"unknown summary format {fmt!r}")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables, in the shared folder the cluster names.

    Only a local session without ``spark.checkpoint.dir`` uses a temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=f"{label}-")
