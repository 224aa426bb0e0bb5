"""Freshness report text, one block per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import outdated

FORMATS = ("detailed", "summary", "raw")


def render_outdated(parsed: DataFrame, output_format: str = "detailed", include_dev: bool = True) -> DataFrame:
    """``(project, ord, line)`` for projects with a manifest whose run could be read. A project's report is one row,
    so its lines are built inside that row."""
    if output_format not in FORMATS:
        raise ValueError(f"output_format is one of {', '.join(FORMATS)}")
    listed = outdated.packages()
    if not include_dev:
        listed = F.filter(listed, lambda p: p["type"] != outdated.DEV_TYPE)
    none = F.array().cast("array<string>")
    n = F.size("packages")
    found = outdated.found_message(n)

    def block(p: Column) -> Column:
        return F.array(
            F.concat(F.lit("📦 "), p["package"]),
            F.concat(F.lit("   Current: "), p["current"]),
            F.concat(F.lit("   Wanted:  "), p["wanted"]),
            F.concat(F.lit("   Latest:  "), p["latest"]),
            F.concat(F.lit("   Type:    "), p["type"]),
            F.lit(""),
        )

    # The wording of the report, above and below.
    types = F.transform("packages", lambda p: p["type"])
    if output_format == "detailed":
        body = F.concat(
            F.array(F.concat(found, F.lit(":")), F.lit("")),
            F.flatten(F.transform("packages", block)),
            F.array(
                F.lit(
                    "Run 'npm update' to update to wanted versions or 'npm install <package>@latest' "
                    "for latest versions."
                )
            ),
        )
    elif output_format == "summary":
        body = F.concat(
            F.array(found, F.lit(""), F.lit("Breakdown by type:")),
            F.transform(
                F.array_distinct(types),
                lambda t: F.concat(
                    F.lit("- "), t, F.lit(": "),
                    F.size(F.filter(types, lambda other: other == t)).cast("string"),
                ),
            ),
        )
    else:
        body = F.array(found)
    raw = (
        F.array(F.lit("**Raw Output:**"), F.lit("```"), F.col("raw_output"), F.lit("```"), F.lit(""))
        if output_format == "raw"
        else none
    )
    head = F.array(
        F.lit("# NPM Outdated Check Results"),
        F.lit(""),
        F.concat(F.lit("**Project:** "), "project", F.lit("/package.json")),
        F.concat(F.lit("**Total Packages Checked:** "), F.size(F.map_keys("report")).cast("string")),
        F.lit(""),
    )
    fresh = F.array(F.lit("All packages are up to date! 🎉"))
    lines = F.concat(head, raw, F.when(n == 0, fresh).otherwise(body))
    return (
        outdated.with_manifest(parsed).filter("parsed")
        .withColumn("packages", listed)
        .select("project", F.posexplode(lines).alias("ord", "line"))
        .orderBy("project", "ord")
    )
