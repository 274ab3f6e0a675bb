"""Table readers: format by file name, image folders, null handling at ingestion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mldiag.functions.columns import ref

# Fixed value: the image suffixes looked for by default.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp")


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """Delimited text with a header. Give a schema for large inputs: inference is one more scan."""
    reader = spark.read.option("header", True).options(**options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_tsv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", **options)


def read_json(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """One JSON document holding an array of records; a document cannot be split between tasks."""
    reader = spark.read.option("multiLine", True).options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).parquet(path)


_BY_SUFFIX = {
    ".csv": read_csv,
    ".tsv": read_tsv,
    ".json": read_json,
    ".jsonl": read_json_lines,
    ".ndjson": read_json_lines,
    ".parquet": read_parquet,
}


def reader_for(path: str):
    """The reader for a path: suffix in any case, query string ignored, CSV otherwise."""
    name = path.split("?", 1)[0].rstrip("/").lower()
    return next((r for s, r in _BY_SUFFIX.items() if name.endswith(s)), read_csv)


def read_table(
    spark: SparkSession, path: str, schema=None, columns: Sequence[str] | None = None, **options
) -> DataFrame:
    """Read any supported file or folder on any file system Spark reaches, optionally some columns."""
    df = reader_for(path)(spark, path.split("?", 1)[0], schema, **options)
    return df.select(*[ref(c) for c in columns]) if columns else df


def load_images(
    spark: SparkSession, directory: str, extensions: Sequence[str] = IMAGE_SUFFIXES
) -> DataFrame:
    """(path, filename, label) of image files below a folder, sorted by path.

    The label is the parent folder's name, `unknown` for files directly in the folder. File contents
    are not read.
    """
    suffixes = F.lit("(?i)(" + "|".join(s.lower().replace(".", "\\.") for s in extensions) + ")$")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory).select("path")
    )
    parts = F.split("path", "/")
    root = directory.rstrip("/").split("/")[-1]
    depth = len([p for p in directory.rstrip("/").split("://")[-1].split("/") if p])
    inner = F.size(F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "/"), lambda p: p != ""))
    parent = F.element_at(parts, -2)
    images = files.where(F.regexp_like("path", suffixes)).select(
        "path",
        F.element_at(parts, -1).alias("filename"),
        F.when((inner == depth + 1) & (parent == root), "unknown").otherwise(parent).alias("label"),
    )
    if images.isEmpty():
        raise ValueError(f"No images found in {directory} with extensions {tuple(extensions)}")
    return images.orderBy("path")
