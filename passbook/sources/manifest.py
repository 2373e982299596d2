"""The manifest of imported files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return files.load(path).select(
        F.col("path").alias("filename"), F.col("length").alias("file_size"), F.sha2("content", 256).alias("file_hash")
    )


def statement_files(spark: SparkSession, path: str) -> DataFrame:
    """X5 file_union_dedupe: ``*.csv`` and ``*.txt``, without browser copies named ' (1)'."""
    return without_copies(read_files(spark, path, "*.{csv,txt}"))


def without_copies(files: DataFrame) -> DataFrame:
    """Files whose name does not hold ' (1)', written plainly or as in a URL."""
    return files.filter(~F.element_at(F.split("filename", "/"), -1).rlike(r"( |%20)\(1\)"))


def known_files(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """Incoming files whose content was imported before."""
    return incoming.join(manifest, "file_hash", "left_semi")


def new_files(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """Incoming files not seen before."""
    return incoming.join(manifest, "file_hash", "left_anti")


def merge_manifest(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per content; known files keep their row and take over the new metadata.

    Both sides have file_hash, filename, file_size, record_count and ``metadata`` as
    map<string,string>; keys of the incoming metadata win.
    """
    other = incoming.select(
        "file_hash", *[F.col(c).alias(f"in_{c}") for c in ("filename", "file_size", "record_count", "metadata")]
    )
    old, new = F.col("metadata"), F.col("in_metadata")
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    merged = F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))
    return manifest.join(other, "file_hash", "full").select(
        "file_hash",
        *[F.coalesce(c, f"in_{c}").alias(c) for c in ("filename", "file_size", "record_count")],
        merged.alias("metadata"),
    )
