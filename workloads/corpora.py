"""Corpora derived from the driver's tables: rows become files, one row to one file.

Nothing is grouped to make a file, so a hot key in a table never becomes one huge file. The source
text of a file depends only on the columns that also make its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import corpus_from_table

EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, spread over the cores when it comes in fewer pieces than there are. Large inputs
    have more splits than cores and pass through untouched."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text(*parts: str | Column) -> Column:
    """Concatenate columns and literal strings."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".html", ".py", ".js", ".txt"])), (doc % 4 + 1).cast("int"))
    hours = F.to_timestamp(F.lit(EPOCH)) + F.make_dt_interval(hours=doc.cast("int"))
    return corpus_from_table(
        table(spark, sf_dir, "documents"),
        text(F.col("source"), "/", F.col("lang"), "/", doc, ext),
        "text",
        mtime=hours,
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text(F.col("conv_id"), "/", F.col("turn"), "-", F.col("role"), ".txt")
    return corpus_from_table(table(spark, sf_dir, "conversations"), path, "text")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text("pages/", F.col("page_id"), ".html")
    return corpus_from_table(table(spark, sf_dir, "pages"), path, "html")


def item_columns() -> tuple[Column, Column, Column, Column]:
    """Order, part, supplier and line number of a line item."""
    return F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")


def item_name() -> Column:
    order, part, supp, line = item_columns()
    return text(order, "_", part, "_", supp, "_", line)


def distinct_items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Narrow keys, so that each path is one file. The keys weigh little and the text made from
    them costs much, so the number of partitions is given: sizing them by bytes would leave one."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *more]
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*keys)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return items.repartition(parts, *keys).distinct()


def item_sources(spark: SparkSession, sf_dir: str, ext: str, body: Column) -> DataFrame:
    """One source file per distinct line item."""
    items = distinct_items(spark, sf_dir)
    return corpus_from_table(items, text("items/i", item_name(), ext), body)


def python_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "# item ", line, "\nimport os, parts.p", part, " as part\nfrom suppliers.s", supp, " import (\n    name,\n",
        "    account as acct,\n)\n__all__ = ['Item", line, "',\n    \"load\"]\nclass Item", line,
        "(object):\n    async def load", part, "(self, x=(1,\n        2)):\n        return [\nimport\n]\n",
    )


def rust_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "// item\n// more\nuse parts::{p", part, ",\n    q};\nextern crate s", supp, ";\npub(crate) async fn load", line,
        "() { 1; }\n;\npub struct Item", order, ";\nfn inner", part, "() {};\npub const LAST: u8 = 1",
    )


def go_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "package items\n\nimport \"fmt\"\nimport (\n\t_ \"parts/p", part, "\"\n\ts", line, " \"suppliers/s", supp,
        "\"\n)\n\nconst (\n\tItem", line, " = 1\n\thidden = 2\n)\ntype (\n\tPart", part,
        " struct {\n\t}\n)\nvar Order", order, " = 1\nfunc (i *Item) Load", line, "() {}\nfunc local", supp, "() {}\n",
    )


def java_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "package items;\r\nimport parts.P", part, ";\r\nimport static suppliers.S", supp, ".*;\r\n// import no.Such;\r\n",
        "public class Item", line, " {\r\n}\r\n  interface Order", order, " {}\r\npublic final class Not {}\r\n",
    )


def kotlin_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "package items\nimport parts.P", part, " as Part", line, "\nimport suppliers.*\nimport suppliers.S", supp,
        "\ninternal class Item", line, "\nfun load", order, "() {\n  val inner", part, " = 1\n}\n// class No\n",
    )


def csharp_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "using System;\nusing Part = Parts.P", part, ";\nusing static No.Such;\nnamespace Items\n{\n  public partial class Item",
        line, "\n  internal struct Supp", supp, "\n  public static class Not\n}\n",
    )


def part_specifier() -> Column:
    return text("../../parts/p", F.col("l_partkey"))


def script_body() -> Column:
    order, part, supp, line = item_columns()
    return text(
        "/// <reference path=\"./types.d.ts\" />\n// import no from './no';\nimport part, { name as label, type Size } from '",
        part_specifier(), "';\nimport * as supp from \"../../suppliers/s", supp, "\"; /* import x from 'y' */\n",
        "import 'side-effect';\nconst { log: say, ...rest } = require('logger');\nconst url = \"http://import.it\";\n",
        "export const item", line, " = async (x: number) => { return import('./lazy", supp, "'); };\n",
        "export { label as order", order, " };\nexport default class Item", line, " {}\nfunction local", part, "() {}\n",
        "export interface Shape", supp, " {}\nmodule.exports.legacy = 1;\n",
    )


def lexical_body() -> Column:
    """Quotes, slashes and angle brackets that mean something else than in plain code."""
    order, part, supp, line = item_columns()
    return text(
        "const re = /['\"`]/g; import part from '", part_specifier(), "';\nconst half = a / 2, third = b / 3; import { y } from \"../../suppliers/s",
        supp, "\";\nconst el = <p title=\"it's\">don't {/* won't */ require('in-markup", part, "')} <br/></p>; import q from 'q", order,
        "';\nconst t = `a ${f({k: require('n", supp, "')})} ${`b ${ {x: `c ${import('deep')}`} } '`} require('no')`;\nexport const view", line,
        " = () => <i>'</i>;\nfunction last", part, "() { return <b>'</b>; }\nimport('end');\n",
    )


def declarators_body() -> Column:
    """Statements that declare several names."""
    order, part, supp, line = item_columns()
    return text(
        "export const a", line, " = 1, b", part, " = () => 2, { c, d: e } = f(1, 2), g: Map<string, number, X> = new Map<A, B, C>();\nlet x = 1, y",
        supp, " = function () {}, z = require('", part_specifier(), "'),\n  // note, w = 1\n  v = async (p, q) => p, s = 'a, t = () => 1';\n",
        "for (let i = 0, n = () => 1; ;) {}\nconst outer = () => { const inner = 1, deep = x => x; }, after", order, " = (i, j = 2) => i;\nimport eq = require('eq",
        order, "');\n",
    )


FLAGS = ["A", "N", "R"]
CONFIG = (
    '{ // aliases\n  "compilerOptions": { "baseUrl": ".", "paths": { "@parts/*": ["gone/*", "parts/*"], '
    '"@supp/*": ["suppliers/*"] } } }'
)


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three projects, one per return flag: every line item of the flag is a file that imports its
    part by a relative path and its supplier by an alias or a relative path."""
    _, part, supp, line = item_columns()
    items = distinct_items(spark, sf_dir, "l_returnflag").select(
        F.col("l_returnflag").alias("flag"),
        text("/shop/items/f", line, "/i", item_name(), ".ts").alias("path"),
        text(
            "import p from '", part_specifier(), "';\nimport '../../parts/missing", part, "';\n",
            F.when(part % 2 == 0, text("import s from '../../suppliers/s", supp, "';\n")).otherwise(
                text("import s from '@supp/s", supp, "';\n")
            ),
            "import again from '", part_specifier(), "'; import dup from '@parts/p", part, "';\nexport const item = p;\n",
        ).alias("body"),
    )
    key = F.col("p_partkey")
    place = F.when(key % 3 == 0, "/index.ts").when(key % 3 == 1, ".tsx").otherwise(".ts")
    flags = F.explode(F.array(*map(F.lit, FLAGS))).alias("flag")
    parts = table(spark, sf_dir, "part").select(
        flags, text("/shop/parts/p", key, place).alias("path"), text("export default '", F.col("p_name"), "';\n").alias("body")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        flags, text("/shop/suppliers/s", F.col("s_suppkey"), ".js").alias("path"), F.lit("").alias("body")
    )
    config = spark.range(1).select(flags, F.lit("/shop/tsconfig.json").alias("path"), F.lit(CONFIG).alias("body"))
    rows = items.unionByName(parts).unionByName(suppliers).unionByName(config)
    return corpus_from_table(rows, "path", "body", corpus_id="flag", root=F.lit("/shop"))


def part_tree(spark: SparkSession, sf_dir: str, content: str | None = None) -> DataFrame:
    """One file per part, under its brand and type; empty, or with a column as its content."""
    key = F.col("p_partkey")
    path = text("/", F.col("p_brand"), "/", F.col("p_type"), "/p", key, ".ts")
    return corpus_from_table(
        table(spark, sf_dir, "part"), path, F.lit("") if content is None else content, size=F.col("p_size"), root=F.lit("/")
    )


def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects by brand: some manifests lie below others, some in hidden or excluded places."""
    key = F.col("p_partkey")
    stem = text("/r/", F.col("p_type"), "/s", F.col("p_size"))
    path = (
        F.when(key % 5 == 0, text(stem, "/package.json"))
        .when(key % 5 == 1, text(stem, "/.p", key, "/package.json"))
        .when(key % 5 == 2, text(stem, "/node_modules/p", key, "/package.json"))
        .when(key % 5 == 3, text(stem, "/a/b/c/d", key, "/package.json"))
        .otherwise(text(stem, "/p", key, "/package.json"))
    )
    rows = table(spark, sf_dir, "part").select("p_brand", path.alias("path")).distinct()
    return corpus_from_table(rows, "path", F.lit("{}"), corpus_id="p_brand", root=F.lit("/r"))


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small project per part with an alias config of its own."""
    key = F.col("p_partkey")
    body = text(
        "{ // part ", key, "\n \"compilerOptions\": { \"baseUrl\": \"src", key % 3, "/..\", /* aliases */ \"paths\": {\n",
        " \"@p", key, "/*\": [\"parts/", key, "/*\", \"alt/*\"], \"brand\": [\"", F.col("p_brand"), "\"] } } ",
        F.when(key % 7 == 0, "").otherwise("}"),
    )
    return corpus_from_table(
        table(spark, sf_dir, "part"), F.lit("/c/tsconfig.json"), body, corpus_id="p_partkey", root=F.lit("/c")
    )


def freshness_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package-tool run per part; outputs vary with the key."""
    key, size = F.col("p_partkey"), F.col("p_size")
    report = text(
        "{\"part", key, "\":{\"current\":\"1.", size, "\",\"wanted\":\"2.0\",\"latest\":\"3.0\"",
        F.when(key % 2 == 0, ",\"type\":\"devDependencies\"").otherwise(""), "},\"brand\":{\"current\":\"\",\"latest\":\"9\",",
        "\"location\":\"/m/", key, "\"},\"skipped\":null,\"number\":", size, ",\"list\":[{\"current\":\"1\"}]}",
    )
    return table(spark, sf_dir, "part").select(
        text("/projects/p", key).alias("project"),
        F.when(key % 10 < 4, 1).when(key % 10 < 8, 0).when(key % 10 == 8, 2).cast("int").alias("exit_code"),
        F.when(key % 10 == 0, "").when(key % 10 == 4, " ").when(key % 10 == 1, "{broken").when(key % 10 >= 8, "")
        .otherwise(report).alias("stdout"),
        F.when(key % 10 == 5, "warning").otherwise(report).alias("stderr"),
        (key % 20 != 19).alias("has_manifest"),
        F.when(key % 10 == 9, F.when(key % 4 == 1, "ENOENT").otherwise("SIGTERM")).alias("error_code"),
        F.when(key % 10 == 8, "odd exit").when(key % 8 == 3, "timeout of 10000 ms").when(key % 8 == 7, "spawn ENOTDIR")
        .alias("error_message"),
    )


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten customers to a directory."""
    key = F.col("c_custkey")
    group = F.floor(key / 10)
    path = F.when(key % 4 == 0, text("c/g", group, "/d", key, "/package.json")).when(
        key % 4 == 1, text("c/g", group, "/d", key, "/sub/package.json")
    ).otherwise(text("c/g", group, "/file_", key, ".json"))
    return corpus_from_table(table(spark, sf_dir, "customer"), path, F.lit(""), size=F.lit(0))


def customer_requests(spark: SparkSession, sf_dir: str, stem: str, suffix: str = "") -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("").alias("corpus_id"),
        key.alias("request_id"),
        text("c/g", F.floor(key / 10), "/", stem, key, suffix).alias("path"),
    )
