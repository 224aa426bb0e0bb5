"""Package-freshness reports: the JSON that the package tool printed, one row per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_space


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def parse_outdated(runs: DataFrame) -> DataFrame:
    """Add ``report`` (package → JSON value), ``raw_output`` and ``parsed`` to
    ``(project, exit_code, stdout, stderr)`` rows.

    Exit 0 reads stdout, or stderr when stdout is blank and stderr holds a brace; exit 1 reads
    stdout, or stderr when stdout is empty. Bad JSON is an empty report, not a failure.
    """
    out, err, code = F.col("stdout"), F.col("stderr"), F.col("exit_code")
    chosen = F.when(
        code == 0,
        F.when(_filled(trim_space(out)), out).when(err.contains("{"), err),
    ).when(code == 1, F.when(_filled(out), out).otherwise(err))
    report = F.from_json(chosen, "map<string,variant>")
    return runs.withColumns(
        {
            "report": F.coalesce(report, F.from_json(F.lit("{}"), "map<string,variant>")),
            "raw_output": F.coalesce(F.when(_filled(out), out).otherwise(err), F.lit("")),
            "parsed": code.isin(0, 1),
        }
    )
