"""What to tell callers who name a path that isn't there: the message, with what they may have meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.edits import existing_paths
from ..operators.joins import shuffled
from ..operators.predicates import allowed
from ..operators.suggestions import PATH_LIMIT, suggest_paths, suggest_project

#: Who asks: search and overview for a directory, the freshness report for a directory with a manifest, renames and deletes for any path.
ASKERS = ("search", "explore", "outdated", "rename", "delete")


def _message(asker: str, path: Column) -> Column:
    # The wording of the messages.
    before, after = {
        "search": ("The path '", "' does not exist or cannot be accessed."),
        "explore": ("The path '", "' does not exist or is not a directory."),
        "outdated": ('package.json not found in "', '".'),
        "rename": ('Source path "', '" does not exist.'),
        "delete": ('Path "', '" does not exist.'),
    }[asker]
    return F.concat(F.lit(before), path, F.lit(after))


def missing_paths(files: DataFrame, requests: DataFrame, asker: str, roots: list[str] | None = None) -> DataFrame:
    """``(corpus_id, request_id, path, suggestions, message)`` for the requests (``corpus_id``, ``request_id``, ``path``) whose path isn't what the asker
    needs: a directory for ``search`` and ``explore``, a manifest in it for ``outdated``, anything for ``rename`` and ``delete``. Requests
    outside the allow-list get no suggestions but an error of their own, and aren't listed here.

    Works on paths; each path asked for is looked up and scored once, however many requests name it.
    """
    if asker not in ASKERS:
        raise ValueError(f"asker is one of {', '.join(ASKERS)}")
    asked = requests.select("corpus_id", "request_id", "path").filter(allowed(F.col("path"), roots or []))
    needed = F.concat("path", F.lit("/package.json")) if asker == "outdated" else F.col("path")
    asked = asked.withColumn("at", needed)
    found = existing_paths(files, asked)
    if asker in ("search", "explore"):
        found = found.filter("is_dir")
    missing = asked.join(shuffled(found.select("corpus_id", "at")), ["corpus_id", "at"], "left_anti").select("corpus_id", "request_id", "path")
    if asker == "outdated":
        near = suggest_project(missing, files)
    else:
        near = suggest_paths(missing, files, PATH_LIMIT, dirs_only=asker in ("search", "explore"))
    listed = near.groupBy("corpus_id", "request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))).alias("near"))  # a few each
    meant = F.coalesce(F.transform("near", lambda n: n["suggestion"]), F.array().cast("array<string>"))
    hint = F.when(F.size("suggestions") > 0, F.concat(F.lit(" Did you mean: "), F.array_join("suggestions", ", "), F.lit("?"))).otherwise("")
    answered = missing.join(shuffled(listed), ["corpus_id", "request_id"], "left").withColumn("suggestions", meant)
    return answered.select("corpus_id", "request_id", "path", "suggestions", F.concat(_message(asker, F.col("path")), hint).alias("message"))
