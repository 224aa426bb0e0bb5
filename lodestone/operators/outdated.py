"""Package-freshness rows and roll-ups over parsed reports (see ``dependency_reports``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands in for missing fields.
UNKNOWN = "unknown"
DEFAULT_TYPE = "dependencies"
DEV_TYPE = "devDependencies"


def _text(info: Column, field: str) -> Column:
    """A field as text; empty text, ``false`` and zero count as missing."""
    value = F.try_variant_get(info, f"$.{field}", "string")
    kind = F.schema_of_variant(F.try_variant_get(info, f"$.{field}", "variant"))
    number = F.try_variant_get(info, f"$.{field}", "double")
    falsy = ((kind == "BOOLEAN") & (value == "false")) | (kind.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == 0))
    return F.when(F.coalesce(falsy, F.lit(False)), F.lit(None)).otherwise(F.nullif(value, F.lit("")))


def with_manifest(parsed: DataFrame) -> DataFrame:
    """Runs of projects that have a manifest; without that column, all."""
    return parsed.filter("has_manifest") if "has_manifest" in parsed.columns else parsed


def packages(project: Column | str = "project") -> Column:
    """``report`` as an array of package structs, in report order. Object and list values count,
    scalars do not; missing or empty fields take their defaults."""
    project = F.col(project) if isinstance(project, str) else project
    listed = F.filter(
        F.map_entries("report"),
        lambda e: F.schema_of_variant(e["value"]).rlike("^(?:OBJECT|ARRAY)<"),
    )
    return F.transform(
        listed,
        lambda e: F.struct(
            e["key"].alias("package"),
            F.coalesce(_text(e["value"], "current"), F.lit(UNKNOWN)).alias("current"),
            F.coalesce(_text(e["value"], "wanted"), F.lit(UNKNOWN)).alias("wanted"),
            F.coalesce(_text(e["value"], "latest"), F.lit(UNKNOWN)).alias("latest"),
            F.coalesce(_text(e["value"], "location"), project).alias("location"),
            F.coalesce(_text(e["value"], "type"), F.lit(DEFAULT_TYPE)).alias("type"),
        ),
    )


def explode_outdated(parsed: DataFrame) -> DataFrame:
    """One row per outdated package of a project with a manifest."""
    return with_manifest(parsed).select("project", F.explode(packages()).alias("p")).select("project", "p.*")


def production_only(outdated: DataFrame) -> DataFrame:
    return outdated.filter(F.col("type") != DEV_TYPE)


def outdated_summary(parsed: DataFrame) -> DataFrame:
    """Per project: keys checked, packages outdated. Counted inside the row."""
    return parsed.select(
        "project",
        F.size(F.map_keys("report")).alias("n_checked"),
        F.size(packages()).alias("n_outdated"),
    ).withColumn("has_outdated", F.col("n_outdated") > 0)


def outdated_by_type(outdated: DataFrame) -> DataFrame:
    return outdated.groupBy("project", "type").agg(F.count("*").alias("n"))


def report_status(parsed: DataFrame) -> DataFrame:
    """``(project, status, message)``. Runs carry ``has_manifest``, ``error_code`` and
    ``error_message`` beside the exit code."""
    error = F.coalesce(F.col("error_message"), F.lit(""))
    n = F.size(packages())
    status = (
        F.when(~F.col("has_manifest"), "missing_manifest")
        .when(F.col("parsed") & (n > 0), "outdated")
        .when(F.col("parsed"), "ok")
        .when(F.col("error_code") == "ENOENT", "command_missing")
        .when(error.contains("timeout"), "timeout")
        .when(error.contains("ENOTDIR") | error.contains("ENOENT"), "bad_directory")
        .otherwise("failed")
    )
    # The messages callers see.
    message = (
        F.when(
            F.col("status") == "missing_manifest",
            F.concat(F.lit('package.json not found in "'), "project", F.lit('".')),
        )
        .when(F.col("status") == "outdated", found_message(F.col("n")))
        .when(F.col("status") == "ok", F.lit("All packages are up to date! 🎉"))
        .when(
            F.col("status") == "command_missing",
            F.lit("npm command not found. Please ensure npm is installed and available in your PATH."),
        )
        .when(
            F.col("status") == "timeout",
            F.lit("npm outdated command timed out. The operation took too long to complete."),
        )
        .when(
            F.col("status") == "bad_directory",
            F.concat(F.lit('Invalid project directory: "'), "project", F.lit('"')),
        )
        .otherwise(F.concat(F.lit("Failed to check outdated packages: "), error))
    )
    return (
        parsed.withColumns({"status": status, "n": n})
        .withColumn("message", message)
        .select("project", "status", "message")
    )


def found_message(n: Column) -> Column:
    return F.concat(
        F.lit("Found "), n.cast("string"), F.lit(" outdated package"), F.when(n == 1, "").otherwise("s")
    )
