"""Search options, checked on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from ..operators.ranking import SORTS

OUTPUTS = ("text", "json", "structured")


@dataclass(frozen=True)
class SearchOptions:
    """Zero or empty ``pattern``, ``snippet_length`` and ``max_results`` mean the default; zero is
    a real bound for the sizes. ``max_results=None`` means all files."""

    pattern: str = ".*"
    search_path: str | None = None
    extensions: list[str] | None = None
    exclude_extensions: list[str] | None = None
    exclude_patterns: list[str] | None = None
    regex_mode: bool = False
    case_sensitive: bool = False
    word_boundary: bool = False
    multiline: bool = False
    max_depth: int | None = None
    include_binary: bool = False
    min_size: int | None = None
    max_size: int | None = None
    modified_after: str | None = None
    modified_before: str | None = None
    snippet_length: int = 50
    max_results: int | None = 100
    sort_by: str = "relevance"
    group_by_file: bool = True
    exclude_comments: bool = False
    exclude_strings: bool = False
    output_format: str = "text"

    def __post_init__(self) -> None:
        for name, default in (("pattern", ".*"), ("snippet_length", 50), ("max_results", 100),
                              ("sort_by", "relevance"), ("output_format", "text")):
            if not getattr(self, name) and not (name == "max_results" and self.max_results is None):
                object.__setattr__(self, name, default)
        if self.sort_by not in SORTS:
            raise ValueError(f"sort_by is one of {', '.join(SORTS)}")
        if self.output_format not in OUTPUTS:
            raise ValueError(f"output_format is one of {', '.join(OUTPUTS)}")
        if (self.max_results or 0) < 0 or self.snippet_length < 0:
            raise ValueError("max_results and snippet_length cannot be negative")

    @classmethod
    def from_request(cls, request: dict) -> SearchOptions:
        """From camelCase request arguments; ``path`` is another name for ``searchPath``."""
        known = {f.name for f in fields(cls)}
        given = {re.sub(r"([A-Z])", lambda m: "_" + m[0].lower(), k): v for k, v in request.items()}
        if "path" in given:
            given["search_path"] = given.get("search_path") or given["path"]
            del given["path"]
        given.pop("follow_symlinks", None)  # links are never followed
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown search options: {', '.join(sorted(unknown))}")
        return cls(**{k: v for k, v in given.items() if v is not None})
