"""JavaScript and TypeScript: a file's text is cut into tokens by one expression, in document order.

Comments are removed first, with strings kept. The token expression then takes a string literal, an
import, an export, a declaration head, a call or an assignment at a time, so that code-like text
inside a string is passed over. Each token is small and is classified on its own.

A text in which a quote or slash may mean something else (regular expressions, markup, nested templates), or a statement may declare several names, first goes
through the scanner; others need not. Without it, of the code inside template placeholders only module calls are seen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.arrays import bind
from .common import (
    DECL_TYPE, comma_items, decl, function, given, group, has, no_decls,
    one_segment, quoted_from, render_names, rx, specifier,
)
from .scanner import COMMENT, IDENTIFIER, STRING

_ID, _STRING, _COMMENT = IDENTIFIER, STRING, COMMENT
_TEXT = r"""(?:"[^"\n]++"|'[^'\n]++'|`[^`$\\]++`)"""
_BRACED = r"\{(?:[^{}]++|\{[^{}]*+\})*+\}"
_FREE = r"(?<![\w$.])"
# what may not stand before a function that is a declaration
_NOT_VALUE = (
    r"(?<!(?:[=(,:?&|!\[]|=>|\breturn|\btypeof|\bnew|\bvoid|\bawait|\byield|\basync)<s>?)"
)
_CALL = rf"(?:require|import)<s>*\(<s>*{_TEXT}<s>*(?:,[^()]*+)?\)"
# a bound call is the whole initialiser: nothing may go on with its value
_WHOLE = r"(?!<s>*(?:[.(\[?!&|+*/<>=%^-]|(?:as|satisfies|instanceof|in)\b))"
_PARAMS = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
_FUNCTION_VALUE = (
    rf"(?:async\b<s>*)?(?:function\b|(?:<(?:[^()=<>]++|<[^()=<>]*+>)*+><s>*)?{_PARAMS}<s>*(?::[^=;\n]*+)?=>|{_ID}<s>*=>)"
)
_ANNOTATION = r"(?:<s>*!?<s>*:[^=;\n]*+(?:=>[^=;\n]*+)*+)?"

# What a reference comment may name.
_REFERENCES = ["path", "types", "lib"]

# Quotes, slashes and all that isn't visible ASCII. Listed one by one, for a range is looked up more slowly than a list.
_NOTABLE = "[^" + "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if chr(c) not in "\"'`/") + "]"

_KEYWORDS = "import|export|const|let|var|declare|async|function|require|module|exports"

_START = rf"(?=[\"'`acdefilmrv])(?=[\"'`]|{_FREE}(?:{_KEYWORDS})\b)"
_EQUALS_REQUIRE = rf"import<s>+(?:type<s>+)?{_ID}<s>*=<s>*require<s>*\(<s>*"
_IMPORT_FROM = (
    rf"import<s>*(?:(?:type<s>+)?(?:{_ID}<s>*,?<s>*)?(?:\{{[^}}]*+\}}|\*<s>*as<s>+{_ID})?"
    rf"<s>*from<s>*)?"
)
_VAR = r"(?<!\(<s>?)(?:export<s>+)?(?:declare<s>+)?(?:const|let|var)<s>+(?!enum\b)"
_OTHERS = (
    rf"export<s>+(?:default<s>+)?(?:declare<s>+)?(?:async<s>+)?function\b<s>*\*?<s>*(?:{_ID})?"
    rf"|export<s>+(?:default<s>+)?(?:declare<s>+)?(?:abstract<s>+)?(?:class|interface)\b"
    rf"(?:<s>+(?!(?:extends|implements)\b){_ID})?"
    rf"|export<s>+(?:declare<s>+)?(?:type|enum|const<s>+enum)<s>+{_ID}"
    rf"|{_VAR}(?:{_ID}|{_BRACED})(?:{_ANNOTATION}<s>*=(?![=>])<s>*(?:{_CALL}{_WHOLE}|{_FUNCTION_VALUE})?)?"
    rf"|export<s>+default\b|export<s>*=(?![=>])"
    rf"|(?=async\b|function\b|declare\b){_NOT_VALUE}(?:declare<s>+)?(?:async<s>+)?"
    rf"function\b<s>*\*?<s>*{_ID}"
)
_EXPORTS = rf"(?:module\.exports(?:\.[\w$]++)*+|exports(?:\.[\w$]++)++)<s>*=(?![=>])"
_TOKENS = rx(
    rf"{_START}(?:{_STRING}|{_EQUALS_REQUIRE}{_TEXT}<s>*\)|{_IMPORT_FROM}{_TEXT}|import<s>+type<s>+from<s>*{_TEXT}"
    rf"|export<s>*(?:type<s>+)?(?:\*(?:<s>*as<s>+{_ID})?|\{{[^}}]*+\}})(?:<s>*from<s>*{_TEXT})?"
    rf"|{_OTHERS}|(?:require|import)<s>*\(<s>*{_TEXT}(?=<s>*[,)])|{_EXPORTS})"
)

# The same tokens; the first group holds what a token names, be it an import, a call or bound to a variable, and is empty for others. A
# group that holds a quote or a line end stands for a token that has to be looked at on its own.
_PLAIN_BRACED = r"\{(?:[^{}(]++|\{[^{}(]*+\})*+\}"
_PLAIN_ANNOTATION = r"(?:<s>*!?<s>*:[^=;\n(]*+(?:=>[^=;\n(]*+)*+)?"
_BRACED_EXPORT = r"\{(?:[^}\"'`]*+|[^}\"'`]*\bfrom<s>*[\"'`][^}]*+)\}"
_NAMED = rx(
    rf"{_START}(?:{_STRING}|(?:(?:{_EQUALS_REQUIRE}(?={_TEXT}<s>*\))|{_IMPORT_FROM}|import<s>+type<s>+from<s>*"
    rf"|export<s>*(?:type<s>+)?(?:\*(?:<s>*as<s>+{_ID})?|{_BRACED_EXPORT})<s>*from<s>*"
    rf"|{_VAR}(?:{_ID}|{_PLAIN_BRACED}){_PLAIN_ANNOTATION}<s>*=(?![=>])<s>*(?={_CALL}{_WHOLE})(?:require|import)<s>*\(<s>*"
    rf"|(?:require|import)<s>*\(<s>*(?={_TEXT}<s>*[,)]))[\"'`]"
    rf"|{_VAR}(?:{_ID}|{_BRACED}){_ANNOTATION}<s>*=(?![=>])<s>*(?={_CALL}{_WHOLE}))"
    rf"((?<=\")[^\"\n]++(?=\")|(?<=')[^'\n]++(?=')|(?<=`)[^`$\\]++(?=`)|(?<![\"'`]){_CALL})(?:[\"'`]|(?<=\)))"
    rf"|export<s>*(?:type<s>+)?(?:\*(?:<s>*as<s>+{_ID})?|\{{[^}}]*+\}})(?:<s>*from<s>*{_TEXT})?"
    rf"|{_OTHERS}|{_EXPORTS})"
)


def _code(plain: Column) -> Column:
    """Plain code without comments, with white space outside strings as one character, so that one is enough to look back over. A class
    before each alternation lets most characters fail at once, and a lone blank or line end, which would be replaced by itself, is passed."""
    gap = rf"(?:{_COMMENT}|<b>)"
    code = F.regexp_replace(plain, rx(rf"(?={_NOTABLE})(?:({_STRING}){gap}*+|(?! (?!{gap})){gap}++)"), "$1 ")
    return F.regexp_replace(code, rx(r"(?=[^!-~])(?!\n(?![\n[<b>]]))<b>*+(?:\n<b>*+)++"), "\n")


def _references(raw: Column) -> Column:
    """What reference comments name, kind by kind."""
    named = [
        F.regexp_extract_all(raw, F.lit(rx(rf"(?md)^<s>*///<s>*<reference<s>+{what}=[\"']([^\"']+)[\"']<s>*/><s>*$")), F.lit(1))
        for what in _REFERENCES
    ]
    return F.when(raw.contains("///"), F.concat(*named)).otherwise(F.array().cast("array<string>"))


def script_segments(raw: Column, plain: Column) -> Column:
    """The tokens that declare something, in document order; file references come first."""
    references = F.transform(_references(raw), lambda name: F.concat(F.lit("///"), name))
    return one_segment(F.concat(references, _script_tokens(_code(plain))))


def _script_tokens(code: Column) -> Column:
    tokens = F.transform(
        F.regexp_extract_all(code, F.lit(_TOKENS), F.lit(0)),
        lambda t: F.when(t.startswith("`") & t.contains("${"), _placeholder_calls(t))
        .when(t.rlike("^[\"'`]"), F.array().cast("array<string>"))
        .otherwise(F.array(t)),
    )
    return F.flatten(tokens)


def _placeholder_calls(template: Column) -> Column:
    """The module calls in the placeholders of a template literal."""
    inside = F.array_join(F.regexp_extract_all(template, F.lit(r"\$\{[^{}]*+\}"), F.lit(0)), ";")
    return F.regexp_extract_all(inside, F.lit(rx(rf"{_FREE}(?:require|import)<s>*\(<s>*{_TEXT}(?=<s>*[,)])")), F.lit(0))


def _pair(name: Column, alias: Column) -> Column:
    def differing(v: Column) -> Column:
        alias = F.when(v["alias"] != v["name"], v["alias"])
        return F.struct(v["name"].alias("name"), alias.alias("alias"))

    return given(differing, name=name, alias=alias.cast("string"))


def _listed_names(inside: Column) -> Column:
    """``a, b as c, type D`` of an import or export list."""
    renamed = r"^(\S+)<s>+as<s>+(\S+)\z"

    def one(item: Column) -> Column:
        plain = F.regexp_replace(item, rx(rf"^type<s>+(?={_ID}(?:<s>+as<s>+{_ID})?\z)(?!as<s>)"), "")
        return bind(
            plain,
            lambda p: F.when(
                has(p, renamed), _pair(group(p, renamed, 1), group(p, renamed, 2))
            ).otherwise(_pair(p, F.lit(None))),
        )

    return F.transform(comma_items(F.coalesce(inside, F.lit(""))), one)


def _bound_names(inside: Column) -> Column:
    """``{ a, b: c, d = 1, ...rest }`` of an object pattern; nested patterns bind no direct name."""
    item = rf"^(?:(?:({_ID})|[\"'][^\"']*[\"'])<s>*:<s>*)?({_ID})(?:<s>*=[\s\S]*)?\z"
    flat = F.regexp_replace(inside, rx(rf"[\w$]+<s>*:<s>*[{{\[][^{{}}\[\]]*[}}\]]"), "")
    items = F.filter(comma_items(F.coalesce(flat, F.lit(""))), lambda p: has(p, item))
    return F.transform(
        items,
        lambda p: given(
            lambda v: _pair(
                F.coalesce(v["key"], v["local"]), F.when(v["key"].isNotNull(), v["local"])
            ),
            key=group(p, item, 1),
            local=group(p, item, 2),
        ),
    )


def _import_row(
    source: Column,
    kind: Column | str,
    *,
    type_only: Column | None = None,
    default: Column | None = None,
    namespace: Column | None = None,
    names: Column | None = None,
) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = [quoted_from(source), F.concat(F.lit("kind="), kind)]
    extra = {}
    if type_only is not None:
        parts.append(F.when(type_only, "typeOnly=true"))
        extra["type_only"] = type_only
    if default is not None:
        parts.append(F.concat(F.lit("default="), default))
        extra["default_name"] = default
    if namespace is not None:
        parts.append(F.concat(F.lit("namespace="), namespace))
        extra["namespace"] = namespace
    if names is not None:
        parts.append(render_names("named", names))
        extra["names"] = names
    return decl("import", F.concat_ws(", ", *parts), kind=kind, source=source, **extra)


def _export_row(
    kind: Column | str,
    *,
    source: Column | None = None,
    type_only: Column | None = None,
    names: Column | None = None,
    detail: Column | None = None,
) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts, extra = [F.concat(F.lit("kind="), kind)], {}
    if source is not None:
        parts.append(F.concat(F.lit('from="'), source, F.lit('"')))
        extra["source"] = source
    if type_only is not None:
        parts.append(F.when(type_only, "typeOnly=true"))
        extra["type_only"] = type_only
    if names is not None:
        parts.append(render_names("names", names))
        extra["names"] = names
        extra["name"] = F.when(F.size(names) == 1, F.try_element_at(names, F.lit(1))["name"])
    if detail is not None:
        parts.append(detail)
        extra["detail"] = detail
    return decl("export", F.concat_ws(", ", *parts), kind=kind, **extra)


def _named_export(name: Column) -> Column:
    return _export_row("named", names=F.array(_pair(name, F.lit(None).cast("string"))))


def _declared_export(name: Column, is_default: Column, anonymous: str) -> Column:
    """Export row of a function or class head; null when it is not exported or has no name."""
    return F.when(
        is_default,
        _export_row(
            "default",
            detail=F.coalesce(F.concat(F.lit("name="), name), F.lit(f"anonymous={anonymous}")),
        ),
    ).when(name.isNotNull(), _named_export(name))


def _from_reference(t: Column) -> Column:
    name = F.substr(t, F.lit(4))
    return F.array(specifier(name), _import_row(name, "import", type_only=F.lit(True)))


def _static_import(t: Column) -> Column:
    def parts(v: Column) -> Column:
        return given(
            rows,
            source=v["source"],
            bare=v["bare"],
            type_only=v["type_only"],
            default=group(v["clause"], rf"^({_ID})<s>*(?:,|from<s>*[\"'`])", 1),
            namespace=group(v["clause"], rf"^[^\"'`]*\*<s>*as<s>+({_ID})", 1),
            names=_listed_names(group(v["clause"], r"\{([^}]*)\}", 1)),
        )

    def rows(v: Column) -> Column:
        full = _import_row(
            v["source"], "import", type_only=v["type_only"], default=v["default"],
            namespace=v["namespace"], names=v["names"],
        )
        return F.array(
            specifier(v["source"]),
            F.when(v["bare"], _import_row(v["source"], "side-effect")).otherwise(full),
        )

    typed = rf"^import<s>+type<s>+(?=(?!from\b){_ID}|\{{|\*)"
    return given(
        parts,
        source=group(t, _TEXT_END, 1),
        bare=has(t, r"^import<s>*[\"'`]"),
        type_only=has(t, typed),
        clause=F.regexp_replace(t, rx(rf"{typed}|^import<s>*"), ""),
    )


def _export_list(t: Column) -> Column:
    def rows(v: Column) -> Column:
        source, type_only = v["source"], v["type_only"]
        spread = F.array(_pair(F.lit("*"), v["spread"]))
        row = (
            F.when(
                v["spread"].isNotNull(),
                _export_row("re-export", source=source, type_only=type_only, names=spread),
            )
            .when(v["star"], _export_row("star", source=source, type_only=type_only))
            .otherwise(
                _export_row(
                    F.when(source.isNotNull(), "re-export").otherwise("named"),
                    source=source, type_only=type_only, names=v["names"],
                )
            )
        )
        return F.array(F.when(source.isNotNull(), specifier(source)), row)

    return given(
        rows,
        source=F.when(has(t, r"\bfrom<s>*[\"'`]"), group(t, _TEXT_END, 1)),
        type_only=has(t, r"^export<s>*type\b"),
        star=has(t, r"^export<s>*(?:type<s>+)?\*"),
        spread=group(t, rf"^[^\"'`{{]*\*<s>*as<s>+({_ID})", 1),
        names=_listed_names(group(t, r"\{([^}]*)\}", 1)),
    )


def _function_head(t: Column) -> Column:
    def rows(v: Column) -> Column:
        shown = F.concat_ws(
            ", ",
            F.when(v["name"].isNotNull(), v["name"]).when(v["default"], "<anonymous>"),
            F.when(v["exported"], "exported"),
            F.when(v["default"], "default"),
        )
        return F.array(
            F.when(v["name"].isNotNull() | v["default"], function(v["name"], shown)),
            F.when(v["exported"], _declared_export(v["name"], v["default"], "function")),
        )

    name = rf"\bfunction\b<s>*\*?<s>*({_ID})?\z"
    return given(rows, name=group(t, name, 1), exported=has(t, _EXPORTED), default=has(t, _DEFAULT))


def _type_head(t: Column) -> Column:
    def rows(v: Column) -> Column:
        return F.array(
            F.when(v["class"], _declared_export(v["name"], v["default"], "class")).when(
                v["name"].isNotNull(), _named_export(v["name"])
            )
        )

    return given(
        rows,
        **{
            "name": group(t, rf"{_TYPE_HEAD}<s>+({_ID})\z", 2),
            "class": has(t, r"\bclass\b"),
            "default": has(t, _DEFAULT),
        },
    )


def _variables(t: Column) -> Column:
    def bound(v: Column) -> Column:
        pattern = group(t, rf"{_VAR_HEAD}\{{([\s\S]*?)\}}(?![^{{=]*\}}<s>*=)", 1)
        return given(
            rows,
            name=v["name"],
            exported=v["exported"],
            call=v["call"],
            names=F.when(v["name"].isNull(), _bound_names(pattern)),
            source=F.when(v["call"], group(t, _CALL_TEXT, 1)),
            kind=_call_kind(t),
            is_function=F.when(
                v["name"].isNotNull(),
                has(t, r"(?:=>|\bfunction)\z") & has(t, r"[^=]=<s>*[^=>]"),
            ),
        )

    def rows(v: Column) -> Column:
        shown = F.concat_ws(", ", v["name"], F.when(v["exported"], "exported"))
        single = v["name"].isNotNull()
        return F.concat(
            F.array(
                F.when(v["call"], specifier(v["source"])),
                F.when(
                    v["call"] & single, _import_row(v["source"], v["kind"], default=v["name"])
                ).when(v["call"], _import_row(v["source"], v["kind"], names=v["names"])),
                F.when(v["is_function"], function(v["name"], shown)),
                F.when(v["exported"] & single, _named_export(v["name"])),
            ),
            F.when(
                v["exported"] & ~single,
                F.transform(v["names"], lambda n: _named_export(F.coalesce(n["alias"], n["name"]))),
            ).otherwise(no_decls()),
        )

    return given(
        bound,
        name=group(t, rf"{_VAR_HEAD}({_ID})", 1),
        exported=has(t, _EXPORTED),
        call=has(t, rf"=<s>*{_CALL}\z"),
    )


def _call(t: Column) -> Column:
    def rows(v: Column) -> Column:
        return F.array(specifier(v["source"]), _import_row(v["source"], v["kind"]))

    return given(rows, source=group(t, _CALL_TEXT, 1), kind=_call_kind(t))


def _import_equals(t: Column) -> Column:
    def rows(v: Column) -> Column:
        return F.array(
            specifier(v["source"]), _import_row(v["source"], "import=", default=v["name"])
        )

    return given(rows, source=group(t, _TEXT_END, 1), name=group(t, _EQUALS, 1))


def _call_kind(t: Column) -> Column:
    return F.when(has(t, r"\bimport<s>*\("), "dynamic").otherwise("require")


_TEXT_END = r"[\"'`]([^\"'`\n]+)[\"'`]<s>*\)?\z"
_CALL_TEXT = r"(?:require|import)<s>*\(<s>*[\"'`]([^\"'`\n]+)"
_EXPORTED = r"^export\b"
_DEFAULT = r"^export<s>+default\b"
_EQUALS = rf"^import<s>+(?:type<s>+)?({_ID})<s>*="
_FUNCTION_HEAD = r"^(?:export<s>+(?:default<s>+)?)?(?:declare<s>+)?(?:async<s>+)?function\b"
_TYPE_HEAD = (
    r"^export<s>+(?:default<s>+)?(?:declare<s>+)?(?:abstract<s>+)?"
    r"(class|interface|type|enum|const<s>+enum)\b"
)
_VAR_HEAD = r"^(?:export<s>+)?(?:declare<s>+)?(?:const|let|var)<s>+"


def script(t: Column, _state: Column) -> Column:
    target = F.regexp_replace(t, rx(r"<s>*=\z"), "")
    assigned = F.array(_export_row("cjs", detail=F.concat(F.lit("target="), target)))
    # the first word leaves few expressions to try; all tokens begin with one that ends there
    imported = (
        F.when(has(t, _EQUALS), _import_equals(t)).when(has(t, r"^import<s>*\("), _call(t)).otherwise(_static_import(t))
    )
    exported = (
        F.when(has(t, r"^export<s>*(?:type<s>+)?[*{]"), _export_list(t))
        .when(has(t, _TYPE_HEAD), _type_head(t))
        .when(has(t, _VAR_HEAD), _variables(t))
        .when(has(t, _FUNCTION_HEAD), _function_head(t))
        .when(has(t, _DEFAULT), F.array(_export_row("default")))
        .otherwise(F.array(_export_row("export=")))
    )
    decls = (
        F.when(t.startswith("import"), imported)
        .when(t.startswith("export") & ~t.startswith("exports"), exported)
        .when(t.startswith("module") | t.startswith("exports"), assigned)
        .when(t.startswith("require"), _call(t))
        .when(t.startswith("///"), _from_reference(t))
        .otherwise(F.when(has(t, _VAR_HEAD), _variables(t)).otherwise(_function_head(t)))
    )
    return decls.cast(f"array<{DECL_TYPE}>")


def script_specifiers(raw: Column, plain: Column) -> Column:
    """The modules that a text names, in the order of its tokens, repeated ones included. One expression reads them off the whole text; only
    texts with placeholders or with quotes inside a name are cut into tokens that are looked at one by one."""

    def of(code: Column) -> Column:
        one_by_one = F.array_compact(F.transform(_script_tokens(code), script_specifier))
        return bind(
            F.regexp_extract_all(code, F.lit(_NAMED), F.lit(1)),
            lambda found: F.when(code.contains("${") | F.array_join(found, "").rlike("[\"'`\n]"), one_by_one).otherwise(F.array_remove(found, "")),
        )

    return F.concat(_references(raw), bind(_code(plain), of))


def script_specifier(t: Column) -> Column:
    """The module that a token names, or null."""
    called = has(t, r"^(?:import|require)<s>*\(") | (has(t, _VAR_HEAD) & has(t, rf"=<s>*{_CALL}\z"))
    return (
        F.when(t.startswith("///"), F.substr(t, F.lit(4)))
        .when(has(t, _EQUALS), group(t, _TEXT_END, 1))
        .when(called, group(t, _CALL_TEXT, 1))
        .when(has(t, r"^import\b|^export<s>*(?:type<s>+)?[*{][^\"'`]*\bfrom<s>*[\"'`]"), group(t, _TEXT_END, 1))
    )
