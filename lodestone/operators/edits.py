"""Batch renames and deletes on a file table.

All requests of a batch are judged against the table as it was given; ``rename_in_order`` applies them one after another instead.
Directories exist through the files below them. Where two requests touch the same file, the lower ``request_id`` applies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dirname
from ..materialize import materialize
from ..sources.tables import describe_files
from .joins import salted_join, shuffled
from .lookup import PathTable, path_key, self_and_above
from .predicates import allowed


def existing_paths(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of ``wanted`` (``corpus_id``, ``at``), the paths that are a file or a directory, with
    ``is_dir``."""
    reached = files.select("corpus_id", "path", F.explode(self_and_above(F.col("path"))).alias("at"))
    return (
        salted_join(reached, wanted.select("corpus_id", "at").distinct(), ["corpus_id", "at"], ["path"])
        .groupBy("corpus_id", "at")
        .agg(F.max(F.col("at") != F.col("path")).alias("is_dir"))
    )


def _first_of_each_path(requests: DataFrame, *columns: str) -> DataFrame:
    """The first request of each path, with a key for looking it up."""
    first = requests.groupBy("corpus_id", "at").agg(F.min(F.struct("request_id", *columns)).alias("r"))
    key = path_key(F.col("corpus_id"), F.col("at")).alias("key")
    return materialize(first.select(key, "corpus_id", "at", "r.request_id", *[f"r.{c}" for c in columns]), "rules")


def _with_rule(files: DataFrame, rules: DataFrame, order: str, *columns: str) -> DataFrame:
    """``files`` with the rule in ``_rule`` that reaches each, or null: of several the one with the least ``order``. Rules are looked up inside the rows if there are
    few enough to send; more are joined with the files below them, and rows that a rule reaches are shuffled by path."""
    values = (order, "at", *columns)
    table = PathTable.of(rules, "key", *values)
    if table is not None:
        found = table.found(F.col("corpus_id"), F.col("path"))
        least = F.array_min(F.transform(found, lambda e: F.struct(*[e[v].alias(v) for v in values])))
        return files.withColumn("_rule", least if table else F.lit(None).cast(rules.select(F.struct(*values)).schema[0].dataType))
    reached = files.select("corpus_id", "path", F.explode(self_and_above(F.col("path"))).alias("at"))
    touched = salted_join(reached, rules.select("corpus_id", *values), ["corpus_id", "at"], ["path"])
    touched = touched.groupBy("corpus_id", "path").agg(F.min(F.struct(*values)).alias("_rule"))
    return files.join(shuffled(touched), ["corpus_id", "path"], "left")


def _moved(files: DataFrame) -> DataFrame:
    """The file table with paths under ``_rule.at`` put under ``_rule.new_path``; contents stay where they are."""
    new_path = F.when(F.col("_rule").isNotNull(), F.concat("_rule.new_path", F.substr("path", F.length("_rule.at") + 1))).otherwise(F.col("path"))
    extra = ["content"] if "content" in files.columns else []
    return describe_files(files.withColumn("path", new_path), *extra)


def rename_status(files: DataFrame, requests: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """``(corpus_id, request_id, old_path, new_path, status)`` with status ``rename``, ``move``,
    ``source_outside``, ``destination_outside``, ``source_missing``, ``destination_exists`` or
    ``failed`` (into itself)."""
    old, new = F.col("old_path"), F.col("new_path")
    wanted = requests.select("corpus_id", F.explode(F.array(old, new)).alias("at"))
    found = existing_paths(files, wanted)
    checked = (
        requests.join(
            shuffled(found.select("corpus_id", F.col("at").alias("old_path"), F.lit(True).alias("has_old"))),
            ["corpus_id", "old_path"],
            "left",
        )
        .join(
            shuffled(found.select("corpus_id", F.col("at").alias("new_path"), F.lit(True).alias("has_new"))),
            ["corpus_id", "new_path"],
            "left",
        )
        .withColumn(
            "status",
            F.when(~allowed(old, roots or []), "source_outside")
            .when(~allowed(new, roots or []), "destination_outside")
            .when(F.col("has_old").isNull(), "source_missing")
            .when(F.col("has_new").isNotNull(), "destination_exists")
            .when(new.startswith(F.concat(old, F.lit("/"))), "failed")
            .when(dirname(old) == dirname(new), "rename")
            .otherwise("move"),
        )
    )
    # of several good requests for one destination the first takes it: a minimum, which is taken before the shuffle
    good = F.col("status").isin("rename", "move")
    first = checked.filter(good).groupBy("corpus_id", "new_path").agg(F.min("request_id").alias("taken_by"))
    late = good & (F.col("request_id") > F.col("taken_by"))
    return checked.join(shuffled(first), ["corpus_id", "new_path"], "left").select(
        "corpus_id",
        "request_id",
        "old_path",
        "new_path",
        F.when(late, "destination_exists").otherwise(F.col("status")).alias("status"),
    )


def rename_paths(
    files: DataFrame, requests: DataFrame, roots: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The file table after the good requests, and the status of every request. ``requests`` has
    ``corpus_id``, ``request_id``, ``old_path``, ``new_path``. Files are looked up in the good requests inside their rows (see
    ``lookup``), so up to ``lookup.MOST`` of these no content is shuffled. Runs jobs while the plan is built."""
    status = rename_status(files, requests, roots)
    good = status.filter(F.col("status").isin("rename", "move")).select(
        "corpus_id", "request_id", F.col("old_path").alias("at"), "new_path"
    )
    return _moved(_with_rule(files, _first_of_each_path(good, "new_path"), "request_id", "new_path")), status


def delete_status(files: DataFrame, requests: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """``(corpus_id, request_id, path, recursive, force, status)`` with status ``deleted_file``,
    ``deleted_directory``, ``outside``, ``missing`` or ``not_empty``."""
    found = existing_paths(files, requests.select("corpus_id", F.col("path").alias("at")))
    return (
        requests.join(
            shuffled(found.select("corpus_id", F.col("at").alias("path"), "is_dir")), ["corpus_id", "path"], "left"
        )
        .withColumn(
            "status",
            F.when(~allowed(F.col("path"), roots or []), "outside")
            .when(F.col("is_dir").isNull(), "missing")
            .when(~F.col("is_dir"), "deleted_file")
            .when(F.col("recursive"), "deleted_directory")
            .otherwise("not_empty"),
        )
        .select("corpus_id", "request_id", "path", "recursive", "force", "status")
    )


def delete_paths(
    files: DataFrame, requests: DataFrame, roots: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The file table without the deleted files, and the status of every request. ``requests`` has
    ``corpus_id``, ``request_id``, ``path``, ``recursive``, ``force``; ``force`` is only reported. No content is shuffled for up to ``lookup.MOST`` good requests. Runs jobs
    while the plan is built."""
    status = delete_status(files, requests, roots)
    good = status.filter(F.col("status").startswith("deleted")).select(
        "corpus_id", "request_id", F.col("path").alias("at")
    )
    found = _with_rule(files, _first_of_each_path(good), "request_id")
    return found.filter(F.col("_rule").isNull()).select(*files.columns), status


def _first_of_related(pending: DataFrame) -> DataFrame:
    """The requests that no earlier one concerns: none of their paths is, or lies above or below, a path of a request with a smaller id."""
    touched = pending.select("corpus_id", "request_id", F.explode(F.array("old_path", "new_path")).alias("at"))
    spread = touched.select("corpus_id", "request_id", "at", F.explode(self_and_above(F.col("at"))).alias("above"))
    here = touched.groupBy("corpus_id", "at").agg(F.min("request_id").alias("least")).withColumnRenamed("at", "above")
    above = spread.join(shuffled(here), ["corpus_id", "above"]).select("corpus_id", "request_id", "least")
    under = spread.groupBy("corpus_id", "above").agg(F.min("request_id").alias("least")).withColumnRenamed("above", "at")
    below = touched.join(shuffled(under), ["corpus_id", "at"]).select("corpus_id", "request_id", "least")
    least = above.unionByName(below).groupBy("corpus_id", "request_id").agg(F.min("least").alias("least"))
    return pending.join(shuffled(least.filter("least = request_id").drop("least")), ["corpus_id", "request_id"])


def _put_under(rows: DataFrame, column: str, good: DataFrame) -> DataFrame:
    """``rows`` with the paths in ``column`` rewritten by the one request of ``good`` that reaches them, if any."""
    reached = rows.select("corpus_id", column, F.explode(self_and_above(F.col(column))).alias("old_path"))
    moved = reached.join(shuffled(good.select("corpus_id", "old_path", "new_path")), ["corpus_id", "old_path"])
    moved = moved.select("corpus_id", column, F.concat("new_path", F.substr(column, F.length("old_path") + 1)).alias("_to")).distinct()
    return rows.join(shuffled(moved), ["corpus_id", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def _more_anchors(anchors: DataFrame, good: DataFrame) -> DataFrame:
    """Where the tops of moved trees stood at first (``orig_at``) and stand now (``cur_at``), after the good requests of a round."""
    above = good.select("corpus_id", "old_path", "new_path", F.explode(self_and_above(F.col("old_path"))).alias("cur_at"))
    covers = above.join(shuffled(anchors), ["corpus_id", "cur_at"]).groupBy("corpus_id", "old_path").agg(
        F.max(F.struct(F.length("cur_at").alias("n"), "cur_at", "orig_at")).alias("c")
    )
    known = good.join(shuffled(covers), ["corpus_id", "old_path"], "left")
    suffix = F.substr("old_path", F.length("c.cur_at") + 1)
    fresh = known.filter(F.col("c").isNull() | (F.col("c.cur_at") != F.col("old_path"))).select(
        "corpus_id", F.when(F.col("c").isNull(), F.col("old_path")).otherwise(F.concat("c.orig_at", suffix)).alias("orig_at"), F.col("new_path").alias("cur_at")
    )
    fresh = fresh.join(shuffled(anchors.select("corpus_id", "orig_at")), ["corpus_id", "orig_at"], "left_anti")
    return _put_under(anchors, "cur_at", good).select("corpus_id", "orig_at", "cur_at").unionByName(fresh)


def rename_in_order(files: DataFrame, requests: DataFrame, roots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The file table after the requests of each corpus were applied one after another by ``request_id``, and the status of each, as ``rename_paths`` gives it;
    but each request is judged against the tree as those before it left it, so chains and swaps work.

    Requests that don't concern each other are judged together: a round takes those that no earlier pending one is related to, so there are as many rounds as the
    longest chain of related requests has links. A round works on paths alone, and on those that a request touches. What is carried on are the tops of
    moved trees, from where they stood at first to where they stand; a file goes with the deepest one above it, looked up in its row, so no content is
    shuffled. Request ids are distinct within a corpus. Runs jobs while the plan is built.
    """
    spark = files.sparkSession
    old, new = F.col("old_path"), F.col("new_path")
    columns = ["corpus_id", "request_id", "old_path", "new_path"]
    outside = F.when(~allowed(old, roots or []), "source_outside").when(~allowed(new, roots or []), "destination_outside")
    asked = requests.select(*columns).withColumn("status", outside)
    done = [asked.filter("status IS NOT NULL")]
    pending = materialize(asked.filter("status IS NULL").select(*columns), "pending")
    wanted = pending.select("corpus_id", F.explode(F.array(old, new)).alias("at")).distinct()
    reached = files.select("corpus_id", "path", F.explode(self_and_above(F.col("path"))).alias("at"))
    region = materialize(salted_join(reached, wanted, ["corpus_id", "at"], ["path"]).select("corpus_id", "path").distinct(), "region")
    anchors = spark.createDataFrame([], "corpus_id string, orig_at string, cur_at string")
    while not pending.isEmpty():
        ready = materialize(_first_of_related(pending).select(*columns), "ready")
        found = existing_paths(region, ready.select("corpus_id", F.explode(F.array(old, new)).alias("at"))).select("corpus_id", "at", F.lit(True).alias("there"))
        judged = (
            ready.join(shuffled(found.withColumnsRenamed({"at": "old_path", "there": "has_old"})), ["corpus_id", "old_path"], "left")
            .join(shuffled(found.withColumnsRenamed({"at": "new_path", "there": "has_new"})), ["corpus_id", "new_path"], "left")
            .select(
                *columns,
                F.when(F.col("has_old").isNull(), "source_missing")
                .when(F.col("has_new").isNotNull(), "destination_exists")
                .when(new.startswith(F.concat(old, F.lit("/"))), "failed")
                .when(dirname(old) == dirname(new), "rename")
                .otherwise("move")
                .alias("status"),
            )
        )
        judged = materialize(judged, "judged")
        done.append(judged)
        good = judged.filter(F.col("status").isin("rename", "move"))
        anchors = materialize(_more_anchors(anchors, good), "anchors")
        region = materialize(_put_under(region, "path", good).select("corpus_id", "path"), "region")
        pending = materialize(pending.join(shuffled(ready.select("corpus_id", "request_id")), ["corpus_id", "request_id"], "left_anti"), "pending")
    status = reduce(DataFrame.unionByName, done)
    depth = (-F.length("orig_at")).alias("outwards")  # the deepest one comes first
    key = path_key(F.col("corpus_id"), F.col("orig_at")).alias("key")
    rules = anchors.select(key, "corpus_id", depth, F.col("orig_at").alias("at"), F.col("cur_at").alias("new_path"))
    return _moved(_with_rule(files, rules, "outwards", "new_path")), status
