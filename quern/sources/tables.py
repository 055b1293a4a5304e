"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

CSV_SUFFIXES = (".csv", ".csv.gz", ".tsv", ".tsv.gz")


def separator_of(path: str) -> str:
    return "\t" if ".tsv" in path.lower().rsplit("/", 1)[-1] else ","


def infer_csv_schema(spark: SparkSession, path: str, sep: str, multi_line: bool = False) -> StructType:
    """Schema from one distributed pass over all rows, to be kept and passed to every later scan."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True, quote='"', escape='"', multiLine=multi_line).schema


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    sep: str | None = None,
    strict: bool = True,
    keep_empty: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """CSV or TSV, plain or gzip, with a header.

    ``strict`` fails on a bad value, otherwise it becomes null. Spark reads an
    unquoted empty field as null; ``keep_empty`` turns null text into ''.
    ``multi_line`` keeps line breaks inside quoted cells; files are then read
    whole, one task each.
    """
    sep = sep or separator_of(path)
    schema = schema or infer_csv_schema(spark, path, sep, multi_line)
    df = spark.read.csv(
        path, schema=schema, sep=sep, header=True, mode="FAILFAST" if strict else "PERMISSIVE",
        quote='"', escape='"', multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    if keep_empty:
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        df = df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in texts})
    return df


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """One file or a folder with all its subfolders; no file is an error."""
    try:
        return spark.read.option("recursiveFileLookup", "true").parquet(path)
    except Exception as exc:
        if "UNABLE_TO_INFER_SCHEMA" in str(exc) or "PATH_NOT_FOUND" in str(exc):
            raise ValueError(f"no parquet files below {path}") from exc
        raise


def scan_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Scan by suffix: CSV kinds by name, anything else as Parquet."""
    if path.lower().endswith(CSV_SUFFIXES):
        return scan_csv(spark, path, **options)
    return scan_parquet(spark, path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and time of every file below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), "modificationTime", F.substring_index("path", "/", -1).alias("name"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str, sep: str | None = None, compression: str | None = None) -> None:
    writer = df.write.mode("errorifexists").option("header", True).option("sep", sep or ",").option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path, compression="zstd")
