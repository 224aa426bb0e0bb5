"""File predicates over the metadata columns: none of them touches the content."""

from __future__ import annotations

import posixpath
import re
from datetime import datetime, timezone
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..functions.patterns import to_java_regex
from .lookup import PathTable

# Directory names that are never part of a project's own sources.
DEFAULT_EXCLUDED_DIRS = [
    ".git", "node_modules", ".next", "dist", "build", "#export", ".vscode", ".gradle", ".idea",
]


def _parts(dirs_only: bool = False) -> Column:
    parts = F.split("rel_path", "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1) if dirs_only else parts


def prune_default_dirs(files: DataFrame, applies_to: str = "all") -> DataFrame:
    """``all``: a file named like an excluded directory goes too; ``dirs``: directories only."""
    if applies_to not in ("all", "dirs"):
        raise ValueError("applies_to is 'all' or 'dirs'")
    excluded = F.array(*[F.lit(name) for name in DEFAULT_EXCLUDED_DIRS])
    return files.filter(~F.arrays_overlap(_parts(applies_to == "dirs"), excluded))


def _some_part_like(regex: str) -> Column:
    return F.exists(_parts(), lambda part: part.rlike(regex))


def max_depth(files: DataFrame, depth: int | None) -> DataFrame:
    return files if depth is None else files.filter(F.col("depth") <= depth)


def resolve_roots(roots: list[str], base: str = "/") -> list[str]:
    """Trim, resolve and de-duplicate an allow-list, keeping its order."""
    named = [r.strip() for r in roots if r and r.strip()]
    full = [posixpath.normpath(posixpath.join(base, r.replace("\\", "/"))) for r in named]
    return list(dict.fromkeys(full))


def under_root(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def allowed(path: Column, roots: list[str]) -> Column:
    if not roots:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [under_root(path, r) for r in resolve_roots(roots)])


def under_roots(files: DataFrame, roots: list[str]) -> DataFrame:
    """Keep files at or below one of the roots; no roots keeps all."""
    return files.filter(allowed(F.col("path"), roots)) if roots else files


def under_root_table(files: DataFrame, roots: DataFrame, column: str = "root") -> DataFrame:
    """Keep files at or below one of the roots in a table of resolved paths; an empty table keeps all. Runs jobs while the plan is built.

    Files are looked up in the roots inside their rows, so up to ``lookup.MOST`` roots no content is copied or shuffled. Of more roots, those below others
    are dropped, so that a file meets one at most in a join on its path and directories."""
    named = roots.select(F.rtrim(F.trim(F.col(column)), F.lit("/")).alias("_at")).filter(F.col("_at").isNotNull() & (F.trim(F.col(column)) != ""))
    # the bare root becomes the empty path, which is above all absolute ones
    named = named.distinct()
    table = PathTable.of(named.withColumnRenamed("_at", "key"), "key")
    path = F.col("path")
    reached = F.concat(_paths_above(path), F.array(path))
    if table is not None:
        return files.filter(F.exists(reached, lambda at: table.find(at).isNotNull())) if table else files
    nested = named.select(F.col("_at").alias("_of"), F.explode(_paths_above(F.col("_at"))).alias("_at")).join(named, "_at", "left_semi")
    tops = named.join(nested.select(F.col("_of").alias("_at")), "_at", "left_anti")
    return files.withColumn("_at", F.explode(reached)).join(tops, "_at", "left_semi").drop("_at")


def _paths_above(path: Column) -> Column:
    """The ancestors of a path; of an absolute one also the bare root, as the empty path."""
    bare = F.when(path.startswith("/"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(bare, ancestors(path))


def ext_in(files: DataFrame, exts: list[str] | None) -> DataFrame:
    """Include list in dot form: ``js`` without its dot matches nothing, ``.`` matches files
    without an extension."""
    if not exts:
        return files
    wanted = {e.lower() for e in exts}
    if "." in wanted:
        wanted.add("")
    return files.filter(F.col("ext").isin(sorted(wanted)))


def ext_not_in(files: DataFrame, exts: list[str] | None) -> DataFrame:
    """Exclude list, with or without the dot; a compound suffix never matches."""
    if not exts:
        return files
    dropped = sorted({e.lower() for e in exts})
    bare = F.substring("ext", 2, 1 << 20)
    return files.filter(~(F.col("ext").isin(dropped) | bare.isin(dropped)))


def exclude_names(files: DataFrame, patterns: list[str] | None) -> DataFrame:
    """Drop files with a matching path component. Patterns with ``*`` or ``?`` are unanchored,
    case-insensitive expressions in which the other characters keep their regex meaning; the rest
    are case-sensitive substrings."""
    for pattern in patterns or []:
        if "*" in pattern or "?" in pattern:
            loose = pattern.replace("*", ".*").replace("?", ".")
            files = files.filter(~_some_part_like("(?iu)" + to_java_regex(loose)))
        elif "/" not in pattern:
            # a slash-free substring lies within one component
            files = files.filter(~F.col("rel_path").contains(pattern))
    return files


def size_between(files: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    if low is not None:
        files = files.filter(F.col("size") >= low)
    if high is not None:
        files = files.filter(F.col("size") <= high)
    return files


def parse_moment(value: str | None, zone: str) -> datetime | None:
    """A date with dashes, a month or a year is UTC midnight of its first day; a date-time without offset and a date
    with slashes are in ``zone``; others are ignored."""
    if not value:
        return None
    bare = re.fullmatch(r"(\d{4})(?:-(\d{2})(?:-(\d{2}))?)?", value)
    slashed = re.fullmatch(r"(\d{4})/(\d{1,2})/(\d{1,2})", value)
    try:
        if found := bare or slashed:
            moment = datetime(*(int(part or 1) for part in found.groups()))
        else:
            moment = datetime.fromisoformat(value)
    except ValueError:
        return None
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc if bare else ZoneInfo(zone))
    return moment


def modified_between(
    files: DataFrame, after: str | None = None, before: str | None = None
) -> DataFrame:
    zone = files.sparkSession.conf.get("spark.sql.session.timeZone")
    low, high = parse_moment(after, zone), parse_moment(before, zone)
    if low is not None:
        files = files.filter(F.col("mtime") >= F.lit(low))
    if high is not None:
        files = files.filter(F.col("mtime") <= F.lit(high))
    return files


def drop_hidden(files: DataFrame) -> DataFrame:
    """Drop dot-files by their own name; files inside dot-directories stay."""
    return files.filter(~F.col("basename").startswith("."))
