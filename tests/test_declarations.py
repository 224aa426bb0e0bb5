"""Hand-written sources; the expected lines follow from the rules of each language."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import SPACE, SPACE_INNER
from lodestone.operators.declarations import extract_all, extract_specifiers
from lodestone.operators.declarations.heads import words
from lodestone.operators.declarations.scanner import scan

CASES = {
    "a.py": (
        "# c\nimport os, sys as system\nfrom a.b import (x,\n   y as z,\n)\nfrom .m import x\nfrom q import *\n"
        "__all__ = [\"a\",\n 'b']\nclass A(Base):\n    async def m(self):\n        pass\nx = [\nimport\n]\n"
        "import trailing \\\n   , more\nclass NoParen\nimport os\nimport odd # c\n",
        {
            "import": ['from "os", kind=import', 'from "sys", kind=import, alias=system',
                       'from "a.b", kind=from-import, names={x, y as z}', 'from "q", kind=from-import, names={*}',
                       'from "more", kind=import'],
            "export": ["kind=__all__, name=a", "kind=__all__, name=b", "kind=class, name=A", "kind=def, name=m"],
            "function": ["m"],
            "specifier": ["os", "sys", "a.b", "q", "more"],
        },
    ),
    "b.py": (  # comment lines inside brackets are dropped
        "from m import (\n  a,\n  # note\n  b\n)\n",
        {"import": ['from "m", kind=from-import, names={a, b}'], "specifier": ["m"]},
    ),
    "a.rs": (
        "// h\nuse std::{a,\n  b};\n// c;\npub fn x() { y; }\npub fn hidden() {}\n;\npub struct S;\nfn p() {};\n"
        "extern crate foo;\npub(crate) async fn q() {}",
        {
            "import": ['from "std::{a, b}", kind=use', 'from "foo", kind=extern-crate'],
            "export": ["kind=fn, name=x, vis=pub", "kind=struct, name=S, vis=pub", "kind=fn, name=q, vis=pub(crate)"],
            "function": ["x, exported", "p", "q, exported"],
            "specifier": ["std::{a, b}", "foo"],
        },
    ),
    "a.go": (
        "package main\nimport \"fmt\"\nimport (\n _ \"x\"\n al \"y/z\" // c\n)\nconst (\n A = 1\n b = 2\n)\n"
        "type (\n T struct {\n  Inner int\n }\n)\nfunc (r *T) Get() int { }\nfunc get() {}\nvar V = 1\ntype U int\n",
        {
            "import": ['from "fmt", kind=import', 'from "x", kind=import, alias=_', 'from "y/z", kind=import, alias=al'],
            "export": ["kind=const, name=A", "kind=type, name=T", "kind=type, name=Inner", "kind=func, name=Get",
                       "kind=var, name=V", "kind=type, name=U"],
            "function": ["Get", "get"],
            "specifier": ["fmt", "x", "y/z"],
        },
    ),
    "A.java": (
        "import static a.b.*;\r\nimport a.C;\npublic final class A\n class B {\rpublic interface I\n// class C\n",
        {
            "import": ['from "a.b.*", kind=import-static', 'from "a.C", kind=import'],
            "export": ["kind=class, name=B", "kind=interface, name=I"],
            "specifier": ["a.b.*", "a.C"],
        },
    ),
    "a.kt": (
        "import a.b.*\nimport a.B as C\nfun String.f()\ninternal val x = 1\nprivate class Q",
        {
            "import": ['from "a.B", kind=import, alias=C'],
            "export": ["kind=fun, name=String", "kind=val, name=x"],
            "function": ["String"],
            "specifier": ["a.B"],
        },
    ),
    "a.cs": (
        "using X = A.B;\nusing static A;\nusing A.B;\npublic partial class P\npublic static class N\ninternal struct S",
        {
            "import": ['from "A.B", kind=using-alias, alias=X', 'from "A.B", kind=using'],
            "export": ["kind=class, name=P, vis=public", "kind=struct, name=S, vis=internal"],
            "specifier": ["A.B"],
        },
    ),
    "imports.ts": (
        '/// <reference path="./t.d.ts" />\nimport a, { b as c, type D, e as e } from "m"; // hi\nimport * as ns from \'n\'\n'
        "import type { T } from './t'; import './side';\nimport x = require(\"eq\");\n"
        'const { p: q, ...r } = require("m2"), w = require(\'w2\');\nconst z = require("m").z\n'
        "let dyn = await import('./dyn');\nconst bound = import(\"./bound\");\n"
        "const s = \"require('no')\"; /* import zz from 'zz' */ const url = \"http://x\"; import after from 'after';\n",
        {
            "import": [
                'from "./t.d.ts", kind=import, typeOnly=true', 'from "m", kind=import, default=a, named={b as c, D, e}',
                'from "n", kind=import, namespace=ns', 'from "./t", kind=import, typeOnly=true, named={T}',
                'from "./side", kind=side-effect', 'from "eq", kind=import=, default=x',
                'from "m2", kind=require, named={p as q}', 'from "w2", kind=require, default=w',
                'from "m", kind=require', 'from "./dyn", kind=dynamic', 'from "./bound", kind=dynamic, default=bound',
                'from "after", kind=import, default=after',
            ],
            "specifier": ["./t.d.ts", "m", "n", "./t", "./side", "eq", "m2", "w2", "./dyn", "./bound", "after"],
        },
    ),
    "spaces.ts": (  # any amount of white space and comments between the parts
        "const a = `x ${require('z')} ${ import(\"./y\") } require('no')`;\nuse(" + " " * 60 + "function named() {});\n"
        "for (" + " " * 9 + "const q = require('bare').x;;) {}\nreturn /* c */" + "\n" * 50 + "function inner() {}\n"
        "export   const\n\n  far  =  /* why */ async  ( ) =>  {};\n",
        {
            "import": ['from "z", kind=require', 'from "./y", kind=dynamic', 'from "bare", kind=require'],
            "export": ["kind=named, names={far}"],
            "function": ["far, exported"],
            "specifier": ["z", "./y", "bare"],
        },
    ),
    "lexical.tsx": (  # quotes, slashes and angle brackets by what stands around them
        "const re = /['\"`]/g; import z from 'z'\nconst half = a / 2, r2 = b / 3; import { y } from \"y\";\n"
        "const el = <p title=\"it's\">don't {/* won't */ require('in-markup')} <br/></p>; import q from 'q';\n"
        "const t = `a ${f({k: require('n1')})} ${`b ${ {x: `c ${import('n2')}`} } '`} require('no')`;\n"
        "const g = <T,>(x: T) => x; text.replace(/</g, '&lt;').replace(/[/'\\]]/, require('n3')); if (ok) /\"/.test(x);\n"
        "const u = require('u') as Map<string, number>; export const view = () => <><A b={() => <i>'</i>} /></>;\n"
        "function last() { return <b>'</b>; }\nimport('end');\n",
        {
            "import": ['from "z", kind=import, default=z', 'from "y", kind=import, named={y}', 'from "in-markup", kind=require',
                       'from "q", kind=import, default=q', 'from "n1", kind=require', 'from "n2", kind=dynamic', 'from "n3", kind=require',
                       'from "u", kind=require', 'from "end", kind=dynamic'],
            "export": ["kind=named, names={view}"],
            "function": ["g", "view, exported", "last"],
            "specifier": ["z", "y", "in-markup", "q", "n1", "n2", "n3", "u", "end"],
        },
    ),
    "declarators.ts": (  # every name of a statement
        "export const a = 1, b = () => 2, { c, d: e } = f(1, 2), g: Map<string, number, X> = new Map<A, B, C>(), h = [1, 2, 3];\n"
        "let x = 1, y = function () {}, z = require('zz'),\n  // note, w = 1\n  v = async (p, q) => p, s = 'a, t = () => 1'\nk(1), m = () => 2\n"
        "for (let i = 0, n = () => 1; ;) {}\nconst outer = () => { const inner = 1, deep = () => { let l1 = 1, l2 = x => x; }; }, after = (i, j = 2) => i;\n"
        "export let first: number,\n  second!: string\nf(a, w = require('bare'));\nexport declare const one: A, two: B;\n",
        {
            "import": ['from "zz", kind=require, default=z', 'from "bare", kind=require'],
            "export": [f"kind=named, names={{{n}}}" for n in ("a", "b", "c", "e", "g", "h", "first", "second", "one", "two")],
            "function": ["b, exported", "y", "v", "outer", "deep", "l2", "after"],
            "specifier": ["zz", "bare"],
        },
    ),
    "exports.ts": (
        "export * as ns from \"m3\"; export * from './star'\nexport { a as aa, b }; export type { Q } from './q';\n"
        "export default function () {}\nexport async function* gen(a) { function nested() {} }\n"
        "export default class Foo extends Bar {}\nexport const f1 = async (x: number): Promise<void> => {};\n"
        "export const { u, v: { deep }, k: kk } = obj;\nexport let plain: (a: number) => void;\n"
        "const fn: (a: number) => void = (a) => { };\nconst notfn = (1 + 2);\nconst h = function () {}; const i = x => x;\n"
        "foo(function named() {});\nexport interface I {} export type Al = string; export enum E {A} export const enum CE {}\n"
        "export abstract class AC {} export default class extends X {}\nmodule.exports.a = 1; exports = {}; "
        "exports.b = exports.c = 1;\nexport = foo;\nexport default 5;\nexport declare function dec(): void;\n",
        {
            "export": [
                'kind=re-export, from="m3", names={* as ns}', 'kind=star, from="./star"', "kind=named, names={a as aa, b}",
                'kind=re-export, from="./q", typeOnly=true, names={Q}', "kind=default, anonymous=function",
                "kind=named, names={gen}", "kind=default, name=Foo", "kind=named, names={f1}", "kind=named, names={u}",
                "kind=named, names={kk}", "kind=named, names={plain}", "kind=named, names={I}", "kind=named, names={Al}",
                "kind=named, names={E}", "kind=named, names={CE}", "kind=named, names={AC}", "kind=default, anonymous=class",
                "kind=cjs, target=module.exports.a", "kind=cjs, target=exports.b", "kind=cjs, target=exports.c",
                "kind=export=", "kind=default", "kind=named, names={dec}",
            ],
            "function": ["<anonymous>, exported, default", "gen, exported", "nested", "f1, exported", "fn", "h", "i",
                         "dec, exported"],
            "specifier": ["m3", "./star", "./q"],
        },
    ),
}


@pytest.fixture(scope="module")
def extracted(spark):
    from lodestone.sources.tables import corpus_from_table

    df = spark.createDataFrame([(n, t) for n, (t, _) in CASES.items()], "p string, c string")
    got = defaultdict(lambda: defaultdict(list))
    for r in extract_all(corpus_from_table(df, "p", "c")).orderBy("ord").collect():
        got[r.path][r.section].append(r.rendered)
    return got


@pytest.mark.parametrize("name", list(CASES))
def test_language(extracted, name):
    assert {k: v for k, v in extracted[name].items()} == CASES[name][1]


def test_long_inputs_do_not_overflow(spark, corpus):
    big = "import a from 'a'\nconst s = '" + "x\\'" * 50_000 + "';\n" + "// c\n" * 20_000 + "let t = (" + "a+" * 50_000 + "1)\n"
    rust = "// license\n" * 20_000 + "use x;\n"
    python = "x = [\n" + "'a',\n" * 3_000 + "]\nimport last\n"
    files = corpus({"a.ts": big, "a.rs": rust, "a.py": python})
    got = {(r.path, r.specifier) for r in extract_specifiers(files).collect()}
    assert got == {("a.ts", "a"), ("a.rs", "x"), ("a.py", "last")}


def test_one_scan_and_no_shuffle(corpus):
    files = corpus({"a.ts": "", "b.py": ""})
    for df in (extract_all(files), extract_specifiers(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Scan") == 1


def test_specifiers_alone_are_those_of_all_declarations(corpus):
    files = corpus({name: text for name, (text, _) in CASES.items()})
    whole = extract_all(files).filter("section = 'specifier'").select("path", "ord", "source").collect()
    alone = extract_specifiers(files).select("path", "ord", "specifier").collect()
    listed = lambda rows: [(p, s) for p, _, s in sorted(tuple(r) for r in rows)]
    assert listed(alone) == listed(whole) and alone


def test_repeated_declarations_keep_the_first_place(corpus):
    lines = [f"import a{i % 700} from 'm{i % 700}'\nfunction f{i % 3}() {{}}" for i in range(2_100)]
    rows = extract_all(corpus({"a.ts": "\n".join(lines)})).orderBy("ord").collect()
    assert [r.source for r in rows if r.section == "specifier"] == [f"m{i}" for i in range(700)]
    assert [r.name for r in rows if r.section == "function"] == ["f0", "f1", "f2"]
    assert [r.ord for r in rows] == list(range(1_403))


def test_language_choice(corpus):
    files = corpus({"a.py": "import x", "A.java": "import y;"})
    assert [r.specifier for r in extract_specifiers(files, ["java"]).collect()] == ["y"]
    with pytest.raises(ValueError):
        extract_all(files, ["cobol"])
    assert extract_all(files).select(F.countDistinct("lang")).head()[0] == 2


def test_words_are_matched_as_a_split_gives_them(spark):
    """Without compiling an expression for each text, which ``split`` does."""
    texts = ["", " ", "a", "a b", "  a\t b ", "　", "func (x)  y{", "é﻿ü~!\x7f\x80 z", "\na\n", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(words(F.col("t")).alias("w"), F.split("t", f"{SPACE}+", -1).alias("s"), F.split("t", f"[{SPACE_INNER}]+", -1).alias("plain"))
    assert all(r.w == r.s == r.plain for r in got.collect())
    assert "regexp_extract_all" in str(words(F.col("t")))


def test_specifiers_are_read_off_the_whole_text(corpus):
    """No lambda looks at tokens one by one, but for texts that need it; what those give is the same."""
    files = corpus({"a.ts": "import a from './x'; export { b } from \"y\";\nconst c = require(`z`); use(import('./x'));", "b.ts": "import c from \"it's\";\nf(`${require('p')}`)"})
    found = extract_specifiers(files, ["script"])
    assert [(r.path, r.ord, r.specifier) for r in found.orderBy("path", "ord").collect()] == [
        ("a.ts", 0, "./x"), ("a.ts", 1, "y"), ("a.ts", 2, "z"), ("b.ts", 0, "s"), ("b.ts", 1, "p")
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS pieces" not in plan


def test_scanner_walks_tokens_outside_of_lambdas(corpus):
    """The walk is one function on batches, for the texts that need it; interpreted folds took milliseconds a file."""
    files = corpus({"a.ts": "import a from 'a';", "b.ts": "const re = /'/; f(require('b'), ${ x });", "c.tsx": "const a = <i>'</i>, b = require('c');\nif (x) /\\//.test(y);", "d.py": "x = 1 / 2"})
    found = extract_all(files)
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.path, r.source) for r in found.filter("section = 'specifier'").collect()}
    assert got == {("a.ts", "a"), ("b.ts", "b"), ("c.tsx", "c")}


@pytest.mark.parametrize(("text", "markup", "plain"), [
    ("a / b; /'/.test(c)", False, "a / b; 0.test(c)"),
    ("const a = 1, b = f(2, 3)", False, "const a = 1; const  b = f(2, 3)"),
    ("export let a, // c\nb = 1", False, "export let a, \n; export const b = 1"),
    ("x = <p title=\"'\">it's {y}</p>; z", True, "x = 0(y); z"),
    ("x = <p>y", False, "x = <p>y"),
    ("`a ${f({k: `b ${c}`})} '`", False, "`a `+(f({k: `b `+(c)+``}))+` '`"),
    ("${ a }", False, "${ a }"),
    ("if (a) /b/; (a) / b /c", False, "if (a) 0; (a) / b /c"),
    ("", True, ""),
])
def test_plain_code(text, markup, plain):
    assert scan(text, markup) == plain
