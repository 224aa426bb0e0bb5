"""Path scalars on POSIX-style paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import bind

# File classes by extension.
CODE_EXTS = [".js", ".jsx", ".ts", ".tsx", ".py", ".java", ".kt", ".kts", ".go", ".rs", ".cs"]
CONFIG_EXTS = [".json", ".yaml", ".yml", ".toml", ".xml", ".gradle", ".properties"]
SCRIPT_EXTS = [".js", ".jsx", ".ts", ".tsx"]

# Size units.
SIZE_UNITS = ["Bytes", "KB", "MB", "GB", "TB"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    head = F.left(path, F.length(path) - F.length(basename(path)) - 1)
    return (
        F.when(~path.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def path_ext(path: Column) -> Column:
    """Lower-cased last suffix with its dot; '' for dot-files and suffix-less names."""
    return F.lower(raw_ext(path))


def raw_ext(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)$", 1)


def _fold_segments(path: Column, absolute: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return (
            F.when((seg == "") | (seg == "."), acc)
            .when(seg != "..", F.array_append(acc, seg))
            .when(last.isNotNull() & (last != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(absolute, acc)
            .otherwise(F.array_append(acc, seg))
        )

    joined = F.array_join(
        F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"
    )
    return (
        F.when(absolute, F.concat(F.lit("/"), joined))
        .when(joined == "", F.lit("."))
        .otherwise(joined)
    )


def normalize_path(path: Column, base: Column | str | None = None) -> Column:
    """Resolve against ``base`` when relative, then fold ``.``, ``..`` and repeated slashes."""
    if base is not None:
        base = F.lit(base) if isinstance(base, str) else base
        path = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    # most paths are already clean: the fold is interpreted, the test is not
    return F.when(_is_clean(path), path).otherwise(_fold_segments(path, path.startswith("/")))


def _is_clean(path: Column) -> Column:
    return ~path.rlike(r"//|/$|(?:^|/)\.{1,2}(?:/|$)") & (path != "")


def path_from(directory: Column, step: Column) -> Column:
    """``normalize_path`` of ``directory/step``. A step that leads up or stays and then goes down a clean way, which is what most are, is cut
    and joined without the fold."""
    lead = F.regexp_extract(step, r"^(?:\./|(?:\.\./)+)", 0)
    rest = F.substr(step, F.length(lead) + 1)
    kept = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit(""))) + 1 - F.floor(F.length(lead) / 3).cast("int")
    joined = F.concat(F.call_function("substring_index", directory, F.lit("/"), kept), F.lit("/"), rest)
    plain = (lead != "") & (kept > 0) & _is_clean(F.concat(directory, F.lit("/"), rest))
    return F.when(plain, joined).otherwise(normalize_path(F.concat(directory, F.lit("/"), step)))


def relative_path(path: Column, root: Column | str) -> Column:
    root = F.lit(root) if isinstance(root, str) else root
    prefix = F.when(root.isin("/", ""), root).otherwise(F.concat(root, F.lit("/")))
    return F.when(path == root, F.lit("")).when(
        path.startswith(prefix), F.substr(path, F.length(prefix) + 1)
    ).when(path.startswith("/") & root.startswith("/"), _upwards(path, root)).otherwise(path)


def _upwards(path: Column, root: Column) -> Column:
    """The way from ``root`` up to the directory that both share and down to ``path``."""

    def of(parts: Column) -> Column:
        own, other = parts["own"], parts["other"]
        places = F.sequence(F.lit(0), F.least(F.size(own), F.size(other)) - 1)
        same = F.aggregate(
            places, F.lit(0), lambda n, i: F.when((n == i) & (F.get(own, i) == F.get(other, i)), n + 1).otherwise(n)
        )
        return bind(
            same,
            lambda n: F.array_join(
                F.concat(F.array_repeat(F.lit(".."), F.size(other) - n), F.slice(own, n + 1, F.size(own) - n)), "/"
            ),
        )

    split = lambda p: F.filter(F.split(p, "/"), lambda part: part != "")
    return bind(F.struct(split(path).alias("own"), split(root).alias("other")), of)


def ancestors(path: Column) -> Column:
    """Every proper ancestor directory of a path, nearest last (the bare root is left out)."""
    parts = F.split(path, "/")
    return F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda i: F.call_function("substring_index", path, F.lit("/"), i),
        ),
        lambda p: (p != "") & (p != path),
    )


def file_class(ext: Column) -> Column:
    return F.when(ext.isin(CODE_EXTS), "code").when(ext.isin(CONFIG_EXTS), "config")


def format_size(size: Column) -> Column:
    """Base-1024 size, two decimals half-up, trailing zeros dropped; stays in TB from there on."""
    size = size.cast("long")
    top = len(SIZE_UNITS) - 1

    def render(power: int) -> Column:
        unit = 1024**power
        hundredths = F.call_function("div", size * 200 + F.lit(unit), F.lit(2 * unit))
        whole = F.call_function("div", hundredths, F.lit(100))
        cents = hundredths % 100
        return F.concat(
            whole.cast("string"),
            F.when(cents == 0, "")
            .when(cents % 10 == 0, F.concat(F.lit("."), (cents / 10).cast("int").cast("string")))
            .otherwise(F.concat(F.lit("."), F.lpad(cents.cast("string"), 2, "0"))),
            F.lit(" " + SIZE_UNITS[power]),
        )

    text = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" " + SIZE_UNITS[0])))
    for power in range(1, top):
        text = text.when(size < 1024 ** (power + 1), render(power))
    return text.otherwise(render(top))
