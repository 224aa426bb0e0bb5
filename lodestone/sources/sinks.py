"""Result sinks: JSON with the field names callers know, and rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_document(pretty: bool = False) -> Column:
    """A result file as a JSON document."""
    matches = F.transform(
        "matches",
        lambda m: F.struct(
            m["line_no"].alias("lineNumber"),
            m["line"].alias("lineContent"),
            m["match_start"].alias("matchStart"),
            m["match_end"].alias("matchEnd"),
            m["snippet"].alias("snippet"),
        ),
    )
    document = F.struct(
        F.col("path").alias("filePath"),
        F.col("rel_path").alias("relativePath"),
        matches.alias("matches"),
        F.col("size").alias("fileSize"),
        F.col("size_formatted").alias("fileSizeFormatted"),
        iso_utc("mtime").alias("lastModified"),
        F.col("ext").alias("fileExtension"),
    )
    return F.to_json(document, {"pretty": "true"} if pretty else {})


def result_json(results: DataFrame, pretty: bool = False) -> DataFrame:
    """One JSON document per result file."""
    return results.select("corpus_id", "path", json_document(pretty).alias("json"))


def iso_utc(column: str):
    utc = F.to_utc_timestamp(F.col(column), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_json(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    result_json(results).select(F.col("json").alias("value")).write.mode(mode).text(path)


def write_text(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write rendered ``line`` rows; their sort order is kept across the part files."""
    rendered.select(F.col("line").alias("value")).write.mode(mode).text(path)
