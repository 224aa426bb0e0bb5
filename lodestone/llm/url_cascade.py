"""URL verdicts by prefix rules and a cascade of Bloom filters, as expressions over the url alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.materialize import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a level's filter for each key in it.
BITS_PER_KEY = 12
#: A cascade is carried inside the plan, so its first filter may have this many bits (8 MiB) at most.
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # block | allow

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lowered; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; null or no ``://``: empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule], answer: str) -> Column:
    """``answer`` (``name`` or ``verdict``) of the longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        at_host = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        found = F.when(at_host & F.startswith(path, F.lit(rule.path)), F.lit(getattr(rule, answer))).otherwise(found)
    return found


@dataclass(frozen=True)
class Level:
    """One filter: 64-bit words of a bit array, and how many positions a key has in it."""

    number: int
    words: tuple[int, ...]
    hashes: int

    def positions(self, key: Column) -> list[Column]:
        # short enough that no sum or product leaves 64 bits
        first = F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * self.number)), 8)
        step = F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * self.number + 1)), 8)
        return [F.pmod(first + step * F.lit(j), F.lit(64 * len(self.words)).cast("long")) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # a foldable cast: the optimizer turns it into one array that all rows share
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for p in reversed(self.positions(key)):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            found = (F.getbit(word, p.bitwiseAND(F.lit(63)).cast("int")) == 1) & found
        return found


@dataclass(frozen=True)
class Cascade:
    """Levels that encode in turn the listed keys and the other keys that the level before let through."""

    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed; exact for every key of the universe."""
        if not self.levels:
            return F.lit(False)
        answer = F.lit(len(self.levels) % 2 == 1)  # held by all levels
        for level in reversed(self.levels):
            answer = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(answer)
        return answer


def build_cascade(universe: DataFrame, bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> Cascade | None:
    """The cascade for a table ``(key, listed)`` of distinct keys, or None if the listed keys need more than ``max_bits``.

    Each level takes one job over the universe's narrow rows. Filters are built by OR-ing bits per 64-bit word before
    and after a shuffle; the driver gets a filter's words only, never keys. Levels shrink by the false-positive rate,
    and the loop ends with the first level that lets through no key of the other side.
    """
    hashes = max(1, round(bits_per_key * math.log(2)))
    levels: list[Level] = []
    members = {True: F.col("listed"), False: ~F.col("listed")}  # what each side still has to tell apart
    side = True
    while True:
        n = universe.filter(members[side]).count()
        if n == 0:
            return Cascade(tuple(levels))
        size = 64 * math.ceil(n * bits_per_key / 64)
        if size > max_bits:
            return None
        blank = Level(len(levels), (0,) * (size // 64), hashes)
        bits = universe.filter(members[side]).select(F.explode(F.array(*blank.positions(F.col("key")))).alias("p"))
        words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
        )
        filled = list(blank.words)
        for row in words.collect():  # at most max_bits / 64 rows
            filled[row.w] = row.bits
        level = Level(blank.number, tuple(filled), hashes)
        levels.append(level)
        side = not side
        members[side] = members[side] & level.holds(F.col("key"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    listed: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Rows ``(<page_id>, host, path, rule, verdict)``, one for each row of ``pages``.

    The longest rule that fits the url decides. Where none fits, ``block`` stands for a url whose key ``host || path`` is
    in ``listed`` (a table with a column ``key``), told by the cascade, and ``allow`` for all others. A null url, or one without
    ``://``, has empty host and path and the key ``''``. Repeated pages and repeated or null listed keys (these
    match nothing) change nothing; without listed keys or pages the result is all ``allow`` or empty; other columns of
    either table are not looked at.

    The key universe is the distinct keys of all pages, so membership is exact for every page and pages are judged by
    expressions in one scan without a join. The filters' size is checked: if the listed keys need more than
    ``max_bits``, the keys are joined instead.
    """
    parsed = pages.select(
        F.col(page_id), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")
    )
    key = F.concat("host", "path")
    wanted = listed.select(F.col("key").cast("string").alias("key")).filter(F.col("key").isNotNull())
    marked = parsed.select(key.alias("key"), F.lit(True).alias("seen"), F.lit(False).alias("listed")).unionByName(
        wanted.select("key", F.lit(False).alias("seen"), F.lit(True).alias("listed"))
    )
    universe = marked.groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or("listed").alias("listed"))
    universe = materialize(universe.filter("seen").select("key", "listed"), "urls")
    rule = longest_rule(F.col("host"), F.col("path"), rules, "name")
    by_rule = longest_rule(F.col("host"), F.col("path"), rules, "verdict")
    cascade = build_cascade(universe, max_bits=max_bits)
    if cascade is None:
        blocked = universe.filter("listed").select(F.col("key").alias("listed_key"))
        parsed = parsed.join(blocked, key == F.col("listed_key"), "left")
        is_listed = F.col("listed_key").isNotNull()
    else:
        is_listed = cascade.listed(key)
    return parsed.select(
        F.col(page_id),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(by_rule, F.when(is_listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
