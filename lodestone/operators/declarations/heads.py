"""The head of a declaration: words before its name, read from a statement split at white space.

Languages differ in their keywords, not in how a head is built: words of some sets may come first, then the word that
says what is declared, then the name. ``Head`` holds such sets; everything here is built from split and substring.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from ...functions.text import SPACE_INNER, trim_space
from .common import rx


def words(text: Column, limit: int = -1) -> Column:
    """The words of a trimmed text; with a limit the last one is all the rest. A split would compile its expression for each text, so
    without a limit the words are matched, with the empty ones that a split gives around white space at the ends."""
    if limit < 0:
        return F.regexp_extract_all(text, F.lit(rx(rf"[!-~[^{SPACE_INNER}]]++|\A(?=<s>|\z)|(?<=<s>)\z")), F.lit(0))
    return F.split(text, rx("<s>+"), limit)


def identifier(text: Column) -> Column:
    """The name that a text begins with, null if it begins with none."""
    return bind(F.regexp_extract(text, r"^[A-Za-z_]\w*", 0), lambda v: F.when(v != "", v))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z_]\w*\z")


def is_dotted(text: Column) -> Column:
    return text.rlike(r"\A[A-Za-z_][\w.]*\z")


def without_end(text: Column, end: str) -> Column:
    """A text without its last character and the white space before it, null if it ends otherwise."""
    return F.when(text.endswith(end), trim_space(F.substr(text, F.lit(1), F.length(text) - len(end))))


def rest_after(text: Column, part: Column) -> Column:
    """What follows a text's beginning ``part``, trimmed."""
    return trim_space(F.substr(text, F.length(part) + 1))


@dataclass(frozen=True)
class Head:
    """Word sets of a language's declarations. ``before`` has a set for each word that may stand before the kind, in order."""

    kinds: tuple[str, ...]
    before: tuple[tuple[str, ...], ...] = ()

    def read(self, heads: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a struct with ``kind``, ``name`` and the word ``first``, or null where the words are no such head."""
        return bind(heads, lambda held: self._read(held, body))

    def _read(self, heads: Column, body: Callable[[Column], Column]) -> Column:
        at = F.lit(1)
        for allowed in self.before:
            at = at + F.coalesce(F.try_element_at(heads, at).isin(*allowed), F.lit(False)).cast("int")

        def found(place: Column) -> Column:
            kind = F.try_element_at(heads, place)
            name = identifier(F.coalesce(F.try_element_at(heads, place + 1), F.lit("")))
            head = F.struct(kind.alias("kind"), name.alias("name"), F.try_element_at(heads, F.lit(1)).alias("first"), place.alias("place"))
            return bind(head, lambda h: F.when(h["kind"].isin(*self.kinds) & h["name"].isNotNull(), body(h)))

        return bind(at, found)
