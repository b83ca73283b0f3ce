"""Scans: named tables, unions of files, optional sources, stored probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.captured import CapturedException as SparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import safe_name
from ..operators.frames import missing_columns, nulls_for_nans
from ..operators.proba import wide_classes


def _hadoop_glob(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(s.getPath().toString() for s in found) if found else []


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               schema: StructType | str | None = None, nan_is_null: bool = False,
               **options: str) -> DataFrame:
    """One file or directory.

    ``nan_is_null`` is for sources that write missing numbers as NaN; it hides the
    floating columns from filter pushdown, so it is off by default.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return nulls_for_nans(df) if nan_is_null else df


def read_named(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A named table of a folder; the error lists the tables that exist."""
    paths = {p.rsplit("/", 1)[-1].removesuffix(f".{fmt}"): p
             for p in _hadoop_glob(spark, f"{folder}/*")}
    if name not in paths:
        raise KeyError(f"{folder} has no table {name!r}; present: {sorted(paths)}")
    return read_table(spark, paths[name], fmt)


# What a parquet file starts and ends with, and the length beyond which one has rows.
PARQUET_MARK = "PAR1"
EMPTY_BYTES = 64 << 20


def read_union(spark: SparkSession, pattern: str, fmt: str = "parquet",
               **options: str) -> tuple[DataFrame | None, list[str]]:
    """All readable files of a pattern, columns united by name, and the paths of the others.

    Parquet files are one scan: tasks read the footers, merge the schemas and pass over what is no
    parquet. A matched folder without a readable file is reported as a whole, other unreadable files
    one by one. A store that fails is an error, not a file to skip. Where the types of a column
    differ, and in other formats, each file is a scan.
    """
    paths = _hadoop_glob(spark, pattern)
    if fmt != "parquet" or not paths:
        return _union_of_scans(spark, paths, fmt, options)
    try:
        table = spark.read.options(**{**options, "mergeSchema": "true", "ignoreCorruptFiles": "true"}).parquet(*paths)
    except (AnalysisException, Py4JJavaError, SparkException) as e:
        if "CANNOT_MERGE" in str(e):
            return _union_of_scans(spark, paths, fmt, options)
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None, paths
    return table, _unreadable(table, paths)


def _union_of_scans(spark: SparkSession, paths: Sequence[str], fmt: str,
                    options: Mapping[str, str]) -> tuple[DataFrame | None, list[str]]:
    frames, skipped = [], []
    for path in paths:
        try:
            frames.append(read_table(spark, path, fmt, **options))
        except (AnalysisException, Py4JJavaError, SparkException):
            skipped.append(path)
    return (union_all(frames) if frames else None), skipped


def _unreadable(table: DataFrame, paths: Sequence[str]) -> list[str]:
    """The matched paths, or files below them, that hold no parquet.

    A file with rows is readable, which takes its footer only. Of the others the marks at both ends
    tell an empty table from other content. One entry per file comes to the driver, as in any scan.
    """
    spark = table.sparkSession
    uri = F.col("_metadata.file_path").alias("uri")
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", uri, "length")
    with_rows = table.select(uri).distinct().withColumn("good", F.lit(True))
    files = listed.join(with_rows, "uri", "left").select(
        "path", "length", F.coalesce("good", F.lit(False)).alias("good")).collect()
    good = {r.path for r in files if r.good}
    silent = [r.path for r in files if not r.good and r.length <= EMPTY_BYTES]
    if silent:
        def mark(start: int) -> Column:
            return F.substring("content", start, 4) == F.lit(PARQUET_MARK).cast("binary")
        good |= {r.path for r in spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(silent)
                 .where(mark(1) & mark(-4)).select("path").collect()}
    skipped = []
    for path in paths:
        below = sorted(r.path for r in files if r.path == path or r.path.startswith(f"{path}/"))
        bad = [f for f in below if f not in good]
        skipped += [path] if bad and len(bad) == len(below) else bad
    return skipped


def read_by_header(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """CSV files united by the names in their first lines, and their ``source_file``.

    One pass finds the first line of every file, then the files of one header are one scan, whose
    types are found over all of them: jobs and plan grow with the headers, not with the files. Files
    without a line are left out; None without any line.
    """
    if not paths:
        return None
    lines = spark.read.text(list(paths)).select(
        "value", F.col("_metadata.file_path").alias("uri"), F.monotonically_increasing_id().alias("n"),
        F.col("_metadata.file_block_start").alias("start"))
    first = lines.where("start = 0").groupBy("uri").agg(F.min_by("value", "n").alias("header"))
    headers = first.groupBy("header").agg(F.sort_array(F.collect_list(F.url_decode(
        F.replace("uri", F.lit("+"), F.lit("%2B"))))).alias("files")).collect()
    frames = []
    for row in sorted(headers, key=lambda r: r.header):
        frames.append(spark.read.csv(row.files, header=True, inferSchema=True).withColumn(
            "source_file", F.col("_metadata.file_path")))
    return union_all(frames) if frames else None


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_optional(spark: SparkSession, sources: Iterable[str] | Mapping[str, str],
                  required: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Union of the sources that exist and have the columns; fails if none is left."""
    frames, skipped = [], []
    for path in sources:
        if not _hadoop_glob(spark, path):
            skipped.append(f"{path}: not found")
            continue
        df = read_table(spark, path, fmt)
        missing = missing_columns(df, required)
        if missing:
            skipped.append(f"{path}: missing {missing}")
            continue
        frames.append(df)
    if not frames:
        raise FileNotFoundError(f"no usable source; {skipped}")
    return union_all(frames)


def read_probabilities(spark: SparkSession, folder: str, names: Sequence[str],
                       country: str = "country") -> tuple[DataFrame, list[str]]:
    """Stored probability tables of the named countries, and the classes they cover.

    Files are ``{name}_proba.csv`` and ``{name}_holdout*_proba.csv``; the country and
    the holdout share are filled in where a file or a row lacks them.
    """
    def stem(path: Column) -> Column:
        return F.regexp_extract(path, r"([^/]+?)(?:_holdout[^/]*)?_proba\.csv", 1)

    wanted = F.broadcast(spark.createDataFrame([(n,) for n in names], "__name string").select(
        "__name", safe_name(F.col("__name")).alias("__stem")).dropDuplicates(["__stem"]))
    listed = spark.createDataFrame([(p,) for p in _hadoop_glob(spark, f"{folder}/*_proba.csv")], "path string")
    paths = [r.path for r in listed.join(wanted, stem(F.col("path")) == F.col("__stem"), "left_semi").collect()]
    table = read_by_header(spark, sorted(paths))
    if table is None:
        raise FileNotFoundError(f"no probability table in {folder} for {list(names)}")
    for column, default in ((country, F.lit(None).cast("string")), ("holdout_pct", F.lit("LCO"))):
        if column not in table.columns:
            table = table.withColumn(column, default)
    held = F.coalesce(F.col("holdout_pct").cast("string"), F.lit("LCO"))
    named = table.join(wanted, stem(F.col("source_file")) == F.col("__stem")).withColumn("holdout_pct", held)
    filled = named.withColumn(country, F.coalesce(country, "__name")).drop("__name", "__stem", "source_file")
    return nulls_for_nans(filled), wide_classes(filled.columns)
