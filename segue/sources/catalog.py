"""File catalog source: lists media files without reading their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.functions.vocab import AUDIO_EXTENSIONS


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name, with the dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def keep_media(files: DataFrame, exclude: list[str] | None = None, extensions: list[str] | None = None) -> DataFrame:
    """Rows whose ``path`` has a media extension and contains no excluded substring."""
    out = files.where(extension(F.col("path")).isin(extensions or AUDIO_EXTENSIONS))
    for part in exclude or []:
        out = out.where(~F.contains(F.col("path"), F.lit(part)))
    return out


def scan_directory(spark: SparkSession, directory: str, recursive: bool = True,
                   exclude: list[str] | None = None, with_content: bool = False) -> DataFrame:
    """Media files below a folder as ``path, n_bytes, modified`` (and content when asked).

    The content column is pruned unless requested, so a scan only lists files.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*").load(directory)
    )
    cols = ["path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified")]
    if with_content:
        cols.append("content")
    return keep_media(files.select(*cols), exclude)
