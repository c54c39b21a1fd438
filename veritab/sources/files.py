"""Files and folders: listing, manifests, cached texts, sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from veritab.functions.text import base_name, blank_to_empty, file_stem, strip
from veritab.operators.first import keep_first
from veritab.session import materialize

c = F.col
# Endings that earlier stages leave on a workbook's name.
STAGE_SUFFIXES = ["_검증본", "_1차_검사칸", "_2차_추출내역", "_3차_검사결과", "_1단계판정", "_2단계판정", "_3단계판정",
                  "_보조_검사결과", "_보조_추출내역"]
ROSTER_SHEET = "별첨1. 명단"  # fixed value: never opened through a manifest
SUBMITTED, FILES, COLLISION = "제출", "파일", "키충돌"
MANIFEST = (
    f"sheets array<struct<sheet:string,rows:array<struct<`{COLLISION}`:boolean,`{SUBMITTED}`:array<struct<`{FILES}`:array<string>>>>>>>"
)


def read_folder(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, contents included; Spark lists and splits the work."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def scan_manifest(manifests: DataFrame, skip_sheets=(ROSTER_SHEET,), skip_collision: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files to open, counters) from nested manifests in column ``body``.

    Files: ``(wb, key, place, path)``, places from 1 on in order of sheet, row, entry and file; of paths that differ in
    case or slashes only the first in that order stays, as it is written there.
    """
    parsed = manifests.select("wb", F.from_json("body", MANIFEST).alias("m"))
    sheets = parsed.select("wb", F.posexplode("m.sheets").alias("s", "x")).select("wb", "s", "x.sheet", "x.rows").withColumn("skipped", F.coalesce(c("sheet").isin(list(skip_sheets)), F.lit(False)))
    rows = sheets.select("wb", "sheet", "skipped", "s", F.posexplode("rows").alias("r", "x")).withColumn(
        "collides", F.coalesce(c(f"x.{COLLISION}"), F.lit(False)) & F.lit(skip_collision)
    )
    entries = rows.filter(~c("skipped") & ~c("collides")).select("wb", "s", "r", F.posexplode(f"x.{SUBMITTED}").alias("e", "y"))
    paths = entries.select("wb", "s", "r", "e", F.posexplode(f"y.{FILES}").alias("f", "path"))
    folder = F.coalesce(c("path"), F.lit("")).rlike("^$|[/\\\\]$")
    slashed = paths.filter(~folder).withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))
    order = F.struct("s", "r", "e", "f")
    first = slashed.groupBy("wb", F.lower("path").alias("key")).agg(F.min(order).alias("at"), F.min_by("path", order).alias("path"))
    files = first.select("wb", "key", F.row_number().over(Window.partitionBy("wb").orderBy("at")).alias("place"), "path")  # a manifest is one JSON value
    per_book = lambda df, **aggs: df.groupBy("wb").agg(*[e.alias(n) for n, e in aggs.items()])
    counters = per_book(
        sheets, sheets=F.count_if(~c("skipped") & (F.size("rows") > 0)), rows_of_skipped_sheets=F.sum(F.when(c("skipped"), F.size("rows")).otherwise(0))
    ).join(per_book(rows.filter(~c("skipped")), rows=F.count_if(~c("collides")), rows_in_collision=F.count_if(c("collides"))), "wb", "left").join(
        per_book(paths, folders=F.count_if(folder)), "wb", "left"
    ).na.fill(0)
    return files, counters


def missing_files(files: DataFrame, present: DataFrame, root: str = "") -> DataFrame:
    """Files of manifests that are not among the listed paths."""
    full = F.concat(F.lit(root), c("path"))
    return files.withColumn("full", full).join(present.select(c("path").alias("full")), "full", "left_anti").drop("full")


# --- cached texts and sinks -----------------------------------------------------------------

def cached_texts(texts: DataFrame, metas: DataFrame) -> DataFrame:
    """Cached text under the name people know: from the metadata, else its source, else the stem."""
    given = lambda x: F.nullif(F.coalesce(x, F.lit("")), F.lit(""))
    name = F.coalesce(given(c("meta_name")), given(base_name(F.coalesce("source_path", F.lit("")))), c("stem"))
    return texts.join(metas, "stem", "left").filter(blank_to_empty(c("text")) != "").select("stem", name.alias("name"), "text")


def workbook_base(path: Column) -> Column:
    """Name of a workbook without the endings of earlier stages."""
    stem = file_stem(base_name(path))
    out = stem
    for suffix in STAGE_SUFFIXES:
        out = F.replace(out, F.lit(suffix), F.lit(""))
    return F.coalesce(F.nullif(strip(out), F.lit("")), stem)


def safe_part(sheet: Column) -> Column:
    return F.regexp_replace(sheet, "[\\\\/:*?\"<>|]", "")


def output_name(path: Column, sheet: Column, kind: str) -> Column:
    """One output per workbook and sheet, so that runs never overwrite one another."""
    return F.concat(workbook_base(path), F.lit(f"_{kind}_"), safe_part(sheet))


SHEET = ["wb", "sheet"]
FOLDER, FOLDERS = "folder", 64  # sheets are dealt to folders by a hash of their key, so files follow the data and not the number of sheets


def replace_sheets(df: DataFrame, path: str, kind: str = "parquet", schema: T.StructType | None = None) -> None:
    """Replace only the sheets of ``df``; the other sheets of their folders are read and written with them.

    ``schema`` is that of the stored rows, for kinds that do not carry it. Folders are exchanged whole at the end, so
    two runs into one place must follow one another.
    """
    spark = df.sparkSession
    placed = lambda rows: rows.withColumn(FOLDER, F.pmod(F.xxhash64(*SHEET), F.lit(FOLDERS)).cast("int"))
    stored = _stored(spark, path, kind, schema)
    if stored is None:
        new = placed(df)
    else:
        df = materialize(df)
        sheets = materialize(placed(df.select(*SHEET).distinct()))
        folders = [r[0] for r in sheets.select(FOLDER).distinct().collect()]  # at most ``FOLDERS``
        named = sheets.select(*[c(k).alias(f"_{k}") for k in SHEET])
        others = stored.filter(c(FOLDER).isin(folders)).join(named, [c(k).eqNullSafe(c(f"_{k}")) for k in SHEET], "left_anti")
        new = placed(df).unionByName(others, allowMissingColumns=True)
    dealt = new.hint("rebalance", FOLDER)  # a folder in few files, a large one over several tasks
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).format(kind).save(path)


def _stored(spark: SparkSession, path: str, kind: str, schema: T.StructType | None) -> DataFrame | None:
    """What a place holds so far, with its folders; none where nothing has been written."""
    read = spark.read.format(kind)
    read = read.option("mergeSchema", "true") if schema is None else read.schema(T.StructType([*schema, T.StructField(FOLDER, T.IntegerType())]))
    try:
        return read.load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_per_sheet(df: DataFrame, path: str) -> None:
    """Replace only the sheets that this run produced; a repeated or retried run gives the same rows."""
    replace_sheets(df, path)


def read_per_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(FOLDER)


INDEX = "path string, sha256 string, method string, n_chars bigint, at timestamp"


def index_rows(read: DataFrame) -> DataFrame:
    return read.filter(c("status").isin("ok", "empty", "skipped")).select("path", "sha256", "method", "n_chars")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index so far; empty where none has been written."""
    try:
        return spark.read.schema(INDEX).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def append_index(read: DataFrame, path: str) -> None:
    """Add what the index does not hold yet: a file is named by path and content, so a repeated run adds nothing."""
    known = read_index(read.sparkSession, path).select("path", "sha256")
    new = keep_first(index_rows(read), ["path", "sha256"], ["method", "n_chars"]).join(known, ["path", "sha256"], "left_anti")
    new.withColumn("at", F.current_timestamp()).write.mode("append").json(path)
