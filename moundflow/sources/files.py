"""Reading raw pitch logs and reference tables, writing results.

All reads use explicit schemas (no inference pass over the data); all writes
are plain DataFrame writers, so they run on the executors and restart per
task on executor loss.
"""
from __future__ import annotations

import functools
import json
import logging
from typing import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundflow import constants as K
from moundflow.sources.store import open_store
from moundflow.sources.tolerant import HEADER_BYTES, TolerantCsv, fields

log = logging.getLogger(__name__)

# The wanted columns of a raw pitch log and their types
PITCH_LOG_SCHEMA = T.StructType([
    T.StructField("game_pk", T.LongType()), T.StructField("game_date", T.StringType()),
    T.StructField("pitcher", T.LongType()), T.StructField("batter", T.LongType()),
    T.StructField("at_bat_number", T.LongType()), T.StructField("pitch_number", T.LongType()),
    T.StructField("balls", T.IntegerType()), T.StructField("strikes", T.IntegerType()),
    T.StructField("outs_when_up", T.IntegerType()), T.StructField("inning", T.IntegerType()),
    T.StructField("inning_topbot", T.StringType()),
    T.StructField("on_1b", T.LongType()), T.StructField("on_2b", T.LongType()), T.StructField("on_3b", T.LongType()),
    T.StructField("pitch_type", T.StringType()), T.StructField("release_speed", T.DoubleType()),
    T.StructField("release_spin_rate", T.DoubleType()), T.StructField("pfx_x", T.DoubleType()),
    T.StructField("pfx_z", T.DoubleType()), T.StructField("plate_x", T.DoubleType()),
    T.StructField("plate_z", T.DoubleType()), T.StructField("zone", T.DoubleType()),
    T.StructField("stand", T.StringType()), T.StructField("p_throws", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("events", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("launch_speed", T.DoubleType()),
    T.StructField("launch_angle", T.DoubleType()),
    T.StructField("estimated_woba_using_speedangle", T.DoubleType()),
    T.StructField("woba_value", T.DoubleType()),
    T.StructField("home_score", T.IntegerType()), T.StructField("away_score", T.IntegerType()),
    T.StructField("bat_score", T.IntegerType()), T.StructField("fld_score", T.IntegerType()),
    T.StructField("post_bat_score", T.IntegerType()), T.StructField("post_fld_score", T.IntegerType()),
])


def list_files(spark: SparkSession, paths: Iterable[str]) -> list[str]:
    """The data files under paths (files, folders or globs), by any file system
    Spark reads; hidden and marker files are skipped."""
    return [f for f, _ in file_sizes(spark, paths)]


def file_sizes(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, int]]:
    """``list_files`` with the files' bytes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        fs = at.getFileSystem(conf)
        for top in fs.globStatus(at) or []:
            it = fs.listFiles(top.getPath(), True) if top.isDirectory() else None
            if it is None:
                out.append((top.getPath().toString(), top.getLen()))
            while it is not None and it.hasNext():
                f = it.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def read_pitch_log(spark: SparkSession, path: str | list[str], fmt: str = "csv") -> DataFrame:
    """Projected scan of raw pitch logs.  Wanted columns that exist are
    read with their declared types (bad values become null); missing ones are
    reported and added as typed nulls so the plan shape is fixed.  Only headers
    are read eagerly.  CSV files are grouped by header, each group is read by
    its own column names and the groups are united by name, so files may order
    or choose their columns differently."""
    paths = [path] if isinstance(path, str) else list(path)
    if fmt != "csv":
        return _typed(spark.read.format(fmt).option("mergeSchema", True).load(paths), False)
    groups: dict[tuple[str, ...], list[str]] = {}
    for f, header in headers(spark, list_files(spark, paths)):
        groups.setdefault(header, []).append(f)
    if not groups:
        raise FileNotFoundError(f"no files at {paths}")
    frames = [_typed(spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).option("header", True)
                     .option("mode", "PERMISSIVE").csv(files), True) for header, files in sorted(groups.items())]
    return functools.reduce(DataFrame.unionByName, frames)


def headers(spark: SparkSession, files: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Each file's first line as column names, a name that is empty or stands
    twice replaced by its place.  One job reads the first lines of all files."""
    def first(rows: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in rows:
            names = b.column(0).to_pylist()
            lines = []
            for name in names:
                fs, path = open_store(name)
                with fs.open_input_stream(path) as f:
                    lines.append(f.read(HEADER_BYTES).split(b"\n")[0].decode("utf-8", "replace").lstrip("\ufeff").rstrip("\r"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.string())], names=["file", "line"])
    if not files:
        return []
    many = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(f,) for f in files], "file string").repartition(many).mapInArrow(first, "file string, line string").collect()
    out = []
    for r in sorted(rows):
        cols = fields(r.line)
        out.append((r.file, tuple(c if c and cols.index(c) == i else f"_c{i}" for i, c in enumerate(cols))))
    return out


def _typed(raw: DataFrame, text: bool) -> DataFrame:
    """The wanted columns of a raw log under their declared types."""
    missing = [f.name for f in PITCH_LOG_SCHEMA.fields if f.name not in raw.columns]
    if missing:
        log.warning("missing columns: %s", missing)
    cols = [F.lit(None).cast(f.dataType) if f.name in missing else F.col(f.name).try_cast(f.dataType) if text else F.col(f.name).cast(f.dataType)
            for f in PITCH_LOG_SCHEMA.fields]
    return raw.select(*[c.alias(f.name) for c, f in zip(cols, PITCH_LOG_SCHEMA.fields)]).withColumn("game_date", F.to_date("game_date"))


def read_tolerant_csv(spark: SparkSession, candidates: Iterable[str], schema: T.StructType, split_bytes: int | None = None) -> DataFrame:
    """The first candidate path that exists, read by its files' own headers
    (``sources.tolerant``).  A header is the first of a file's first 50 lines that
    names a wanted column; wanted columns it lacks are null.  Lines before it,
    repeated headers, lines with another number of fields and values that are not
    of their column's type are dropped.  An empty typed frame when no candidate
    exists or no file has a header."""
    for p in candidates:
        files = file_sizes(spark, [p])
        if not files:
            continue
        spark.dataSource.register(TolerantCsv)
        reader = spark.read.format("tolerant_csv").option("files", json.dumps(files))
        if split_bytes:
            reader = reader.option("split_bytes", str(split_bytes))
        raw = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).load()
        typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields}
        fits = [F.col(name).isNull() | c.isNotNull() for name, c in typed.items()]
        return raw.where(functools.reduce(lambda a, b: a & b, fits)).select(*[c.alias(name) for name, c in typed.items()])
    return spark.createDataFrame([], schema)


def write_pitch_table(df: DataFrame, path: str, partition_by: str = "game_year") -> None:
    """Parquet sink for pitch-grain tables, partitioned by season so
    later reads prune by year.  Rows are dealt by ranges of (season, game), so
    a season is written by many tasks, each file holding a range of games."""
    if partition_by == "game_year" and "game_year" not in df.columns:
        df = df.withColumn("game_year", F.year("game_date"))
    (df.repartitionByRange(partition_by, "game_pk").sortWithinPartitions(partition_by, "game_pk")
     .write.mode("overwrite").partitionBy(partition_by).parquet(path))


def write_table(df: DataFrame, path: str) -> None:
    """Parquet sink for profile tables (unpartitioned)."""
    df.write.mode("overwrite").parquet(path)


def write_csv_versioned(df: DataFrame, base: str, run_id: str) -> str:
    """CSV with header into ``base/run_id=<id>``; earlier versions stay
    as they are (the backup of the previous file)."""
    out = f"{base.rstrip('/')}/run_id={run_id}"
    df.write.mode("errorifexists").option("header", True).csv(out)
    return out


RE_SCHEMA = "outs int, bases_state string, run_expectancy double"


def run_expectancy_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(outs, bases_state, run_expectancy) from a CSV, bases padded to
    three characters; the built-in 24-state matrix when no file is given."""
    if path is None:
        rows = [(o, b, v) for (o, b), v in K.RUN_EXPECTANCY.items()]
        return spark.createDataFrame(rows, RE_SCHEMA)
    df = spark.read.option("header", True).schema("outs string, bases_state string, run_expectancy string").csv(path)
    return df.select(F.col("outs").try_cast("int").alias("outs"),
                     F.lpad(F.col("bases_state"), 3, "0").alias("bases_state"),
                     F.col("run_expectancy").try_cast("double").alias("run_expectancy"))


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) CSV -> one row per name, the last line winning for a
    duplicated name, sorted by name.  "Last" is by file name, then by the place
    of the split in the file, then by the line in the split."""
    df = spark.read.option("header", True).csv(path)
    id_col, name_col = df.columns[0], df.columns[1]
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return names_of(df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), place.alias("_line")), "_line")


def names_of(rows: DataFrame, line: str) -> DataFrame:
    """(id, name) rows -> one row per name with the id of its last row by
    ``line``, sorted by name."""
    return rows.groupBy("name").agg(F.max_by("id", line).alias("id")).orderBy("name")


def resolve_names(requests: DataFrame, names: DataFrame, name_col: str, id_out: str) -> DataFrame:
    """Name -> id by equi-join; unresolved rows are kept with a flag."""
    n = names.select(F.col("name").alias("_n"), F.col("id").cast("long").alias(id_out))
    j = requests.join(n, requests[name_col] == n["_n"], "left").drop("_n")
    return j.withColumn(f"{id_out}_resolved", F.col(id_out).isNotNull())


def write_metadata(spark: SparkSession, path: str, metrics: DataFrame, feature_cols: list[str],
                   numeric: list[str], categorical: list[str]) -> None:
    """Metrics per split plus the feature lists as JSON documents."""
    cfg = spark.createDataFrame([(feature_cols, numeric, categorical)],
                                "feature_cols array<string>, numeric_cols array<string>, categorical_cols array<string>")
    # one small file each: the rows (one per split) are gathered after they are computed
    metrics.repartition(1).write.mode("overwrite").json(f"{path}/metrics")
    cfg.coalesce(1).write.mode("overwrite").json(f"{path}/inference_config")
