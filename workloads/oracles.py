"""The same results from plain SQL over the tables, sharing no code with the library."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

DOCS = """docs AS (
  SELECT doc_id, source, lang, text, strlen(text) AS size, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime,
    CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.py' WHEN 2 THEN '.js' ELSE '.txt' END AS ext,
    source || '/' || lang || '/' || doc_id
      || CASE doc_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.py' WHEN 2 THEN '.js' ELSE '.txt' END AS path
  FROM documents)"""


def lines_of(source: str, text: str = "text") -> str:
    return f"""lines AS (
  SELECT * EXCLUDE ({text}), unnest(string_split({text}, chr(10))) AS line,
    unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS line_no FROM {source})"""


def hits_of(literal: str) -> str:
    n = len(literal)
    return f"""cut AS (SELECT *, string_split(lower(line), '{literal}') AS p FROM lines WHERE contains(lower(line), '{literal}')),
numbered AS (SELECT *, unnest(range(1, len(p))) AS match_ord FROM cut),
hits AS (
  SELECT * EXCLUDE (p), CAST(list_sum(list_transform(p[1:match_ord], lambda x: length(x))) + {n} * (match_ord - 1) AS BIGINT) AS match_start
  FROM numbered),
found AS (
  SELECT *, match_start + {n} AS match_end,
    substring(line, greatest(match_start - 50, 0) + 1, match_start + {n} + 50 - greatest(match_start - 50, 0)) AS snippet
  FROM hits)"""


def counts_of(literal: str, text: str = "text") -> str:
    return f"len(string_split(lower({text}), '{literal}')) - 1"


SIZE_TEXT = """CASE WHEN size < 1024 THEN size || ' Bytes'
  WHEN size < 1048576 THEN regexp_replace(printf('%.2f', round(size * 100 / 1024.0) / 100), '\\.?0+$', '') || ' KB'
  WHEN size < 1073741824 THEN regexp_replace(printf('%.2f', round(size * 100 / 1048576.0) / 100), '\\.?0+$', '') || ' MB'
  WHEN size < 1099511627776 THEN regexp_replace(printf('%.2f', round(size * 100 / 1073741824.0) / 100), '\\.?0+$', '') || ' GB'
  ELSE regexp_replace(printf('%.2f', round(size * 100 / 1099511627776.0) / 100), '\\.?0+$', '') || ' TB' END"""

ISO = "strftime(mtime, '%Y-%m-%dT%H:%M:%S.000Z')"

ORACLES["search_literal_matches"] = f"""WITH {DOCS}, {lines_of('docs')}, {hits_of('the')}
SELECT path, line_no, match_ord, match_start, match_end, snippet FROM found"""

ORACLES["search_count_per_file"] = f"""WITH {DOCS}, c AS (SELECT path, CAST({counts_of('the')} AS BIGINT) AS n_matches FROM docs)
SELECT path, n_matches FROM c WHERE n_matches > 0 ORDER BY n_matches DESC, path LIMIT 100"""

ORACLES["search_case_sensitive"] = f"""WITH {DOCS},
c AS (SELECT path, CAST(len(string_split(text, 'The')) - 1 AS BIGINT) AS n_matches FROM docs)
SELECT path, n_matches FROM c WHERE n_matches > 0"""

ORACLES["search_word_boundary"] = f"""WITH {DOCS},
c AS (SELECT path, CAST(len(regexp_extract_all(text, '(?i)\\bde\\b')) AS BIGINT) AS n_matches FROM docs)
SELECT path, n_matches FROM c WHERE n_matches > 0"""

TURNS = "turns AS (SELECT conv_id || '/' || turn || '-' || role || '.txt' AS path, text, strlen(text) AS size FROM conversations)"

ORACLES["search_regex"] = f"""WITH {TURNS}, {lines_of('turns')},
m AS (SELECT path, line_no, regexp_extract_all(line, '(?i)[a-z]+tion\\b') AS hits FROM lines)
SELECT path, line_no, unnest(range(1, len(hits) + 1)) AS match_ord, unnest(hits) AS found FROM m"""

ORACLES["search_regex_counts"] = f"""WITH {TURNS}, {lines_of('turns')},
m AS (SELECT path, CAST(sum(CAST(regexp_matches(line, '^[0-9A-Za-z_]') AS INT) + CAST(regexp_matches(line, '[.!?]$') AS INT)) AS BIGINT) AS n_matches
  FROM lines GROUP BY path)
SELECT path, n_matches FROM m WHERE n_matches > 0"""

PER_FILE = f"""{DOCS}, {lines_of('docs')},
per_line AS (SELECT path, line_no, {counts_of('ing', 'line')} AS n FROM lines),
firsts AS (SELECT path, CAST(sum(n) AS BIGINT) AS n_matches, CAST(min(line_no) AS INTEGER) AS first_line FROM per_line WHERE n > 0 GROUP BY path),
ranked AS (SELECT f.*, d.size, d.mtime FROM firsts f JOIN docs d USING (path))"""


def sorted_sql(order: str, extra: str = "") -> str:
    return f"""WITH {PER_FILE}, o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM ranked)
SELECT place, path, n_matches{extra} FROM o WHERE place <= 50"""


ORACLES["search_sort_relevance"] = sorted_sql("n_matches DESC, path")
ORACLES["search_sort_file"] = sorted_sql("path")
ORACLES["search_sort_line"] = sorted_sql("first_line, path", ", first_line")
ORACLES["search_sort_size"] = sorted_sql("size DESC, path", ", size")
ORACLES["search_sort_modified"] = sorted_sql("mtime DESC, path")

ORACLES["search_flat_topk"] = f"""WITH {DOCS}, {lines_of('docs')}, {hits_of('ing')}
SELECT path, line_no, match_ord, snippet FROM found ORDER BY path, line_no, match_ord LIMIT 200"""

ORACLES["search_head_per_file"] = f"""WITH {DOCS}, {lines_of('docs')}, {hits_of('ing')},
placed AS (SELECT path, line_no, match_start, row_number() OVER (PARTITION BY path ORDER BY line_no, match_ord) AS place,
  count(*) OVER (PARTITION BY path) AS n FROM found)
SELECT path, greatest(n - 10, 0) AS overflow, place, line_no, match_start FROM placed WHERE place <= 10"""

ORACLES["search_summary"] = f"""WITH {DOCS}, c AS (SELECT path, {counts_of('ing')} AS n FROM docs WHERE ext IN ('.py', '.js')),
top AS (SELECT * FROM c WHERE n > 0 ORDER BY n DESC, path LIMIT 40)
SELECT count(*) AS n_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_matches FROM top"""

_STRINGS = "{0}"
for _q in ('"', "''", "`"):
    _c = "'" if _q == "''" else _q
    _STRINGS = (
        "regexp_replace(" + _STRINGS + f", '{_q}(?:[^{_q}\\\\]|\\\\[^\\n\\r])*{_q}', '{_q}{_q}', 'g')"
    )

ORACLES["search_filtered"] = f"""WITH {DOCS}, uncommented AS (
  SELECT path, size, CASE ext WHEN '.py' THEN regexp_replace(text, '#[^\\n\\r]*', '', 'g')
    ELSE regexp_replace(text, '(?s)<!--.*?-->', '', 'g') END AS body
  FROM docs WHERE ext IN ('.py', '.html') AND NOT regexp_matches(source, 'src1.') AND NOT contains(path, 'zz')
    AND size BETWEEN 200 AND 20000 AND mtime BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2034-01-01')
SELECT path, size FROM uncommented WHERE contains(lower({_STRINGS.format('body')}), 'ing')"""

ORACLES["search_all_files"] = f"""WITH {DOCS}, c AS (SELECT path, CAST({counts_of('ing')} AS BIGINT) AS n_matches FROM docs)
SELECT path, n_matches FROM c WHERE n_matches > 0"""

ORACLES["search_below_path"] = f"""WITH {DOCS}, c AS (SELECT *, CAST({counts_of('the')} AS BIGINT) AS n_matches FROM docs WHERE source = 'src0')
SELECT '/r/build/' || path AS path, substring(path, 6) AS rel_path, CAST(1 AS BIGINT) AS depth, n_matches FROM c WHERE n_matches > 0"""

ORACLES["search_text_report"] = f"""WITH {PER_FILE},
top AS (SELECT *, row_number() OVER (ORDER BY n_matches DESC, path) AS block FROM ranked QUALIFY block <= 30),
{hits_of('ing')},
placed AS (SELECT path, line_no, snippet, row_number() OVER (PARTITION BY path ORDER BY line_no, match_ord) AS place FROM found)
SELECT CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS ord, '# Search Results for: "ing"' AS line
UNION ALL SELECT 0, 1, 'Found ' || (SELECT count(*) FROM top) || ' file(s) with matches'
UNION ALL SELECT 0, 2, ''
UNION ALL SELECT block, 0, '## ' || path FROM top
UNION ALL SELECT block, 1, 'Size: ' || {SIZE_TEXT} || ' | Modified: ' || {ISO} FROM top
UNION ALL SELECT block, 2, 'Matches: ' || n_matches FROM top
UNION ALL SELECT block, 3, '' FROM top
UNION ALL SELECT t.block, 3 + p.place, 'Line ' || p.line_no || ': ' || p.snippet FROM placed p JOIN top t USING (path) WHERE p.place <= 10
UNION ALL SELECT block, 14, '... and ' || (n_matches - 10) || ' more matches' FROM top WHERE n_matches > 10
UNION ALL SELECT block, 4 + least(n_matches, 10) + CAST(n_matches > 10 AS INT), '' FROM top"""

ORACLES["search_flat_report"] = f"""WITH {PER_FILE},
top AS (SELECT path FROM ranked ORDER BY path LIMIT 150), {hits_of('ing')},
flat AS (SELECT row_number() OVER (ORDER BY path, line_no, match_ord) AS block, path || ':' || line_no || ': ' || snippet AS line
  FROM found JOIN top USING (path) QUALIFY block <= 150)
SELECT CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS ord, '# Search Results for: "ing"' AS line
UNION ALL SELECT 0, 1, 'Found ' || (SELECT count(*) FROM top) || ' file(s) with matches'
UNION ALL SELECT 0, 2, ''
UNION ALL SELECT block, 0, line FROM flat
UNION ALL SELECT block, 1, '' FROM flat WHERE block = 150
UNION ALL SELECT block, 2, '... search truncated at 150 results' FROM flat WHERE block = 150"""

ORACLES["search_json"] = f"""WITH {PER_FILE}, top AS (SELECT * FROM ranked ORDER BY size DESC, path LIMIT 20), {hits_of('ing')}
SELECT path, {SIZE_TEXT.replace('size', 't.size')} AS size_text, {ISO.replace('mtime', 't.mtime')} AS modified,
  row_number() OVER (PARTITION BY path ORDER BY line_no, match_ord) - 1 AS at, line_no, snippet
FROM found JOIN top t USING (path)"""

ORACLES["search_json_array"] = f"""WITH {PER_FILE}, placed AS (SELECT path, n_matches, row_number() OVER (ORDER BY size DESC, path) AS block FROM ranked)
SELECT block, path, CAST(n_matches AS BIGINT) AS n_matches, CAST(block = count(*) OVER () AS BIGINT) AS is_last FROM placed"""

ORACLES["search_lines_all"] = f"""WITH {PER_FILE}, {hits_of('ing')}
SELECT row_number() OVER (ORDER BY f.size DESC, path, line_no, match_ord) AS block, path || ':' || line_no AS place FROM found f JOIN ranked USING (path)"""

ORACLES["mask_comments_html"] = """WITH m AS (
  SELECT 'pages/' || page_id || '.html' AS path, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS body FROM pages)
SELECT path, length(body) AS n_chars, md5(body) AS digest FROM m"""

ORACLES["mask_strings"] = f"""WITH m AS (SELECT 'pages/' || page_id || '.html' AS path, {_STRINGS.format('html')} AS body FROM pages)
SELECT path, length(body) AS n_chars, md5(body) AS digest FROM m"""

ITEMS = """items AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS l,
  l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber AS item FROM lineitem)"""

ORACLES["mask_comments_code"] = f"""WITH {ITEMS}
SELECT 'items/i' || item || '.ts' AS path, CAST(4 AS BIGINT) AS n, CAST(20 AS BIGINT) AS line_sum,
  length('export const item' || l || ' = async (x: number) => {{ return ') AS start_sum FROM items
UNION ALL SELECT 'items/i' || item || '.py', 3, 18, length('from suppliers.s' || s || ' ') FROM items"""

ORACLES["binary_files"] = f"""WITH {TURNS}
SELECT path, size, CAST(size < 1024 AS INTEGER) AS tail_nul, 1 AS head_nul FROM turns"""

ORACLES["file_facts"] = f"""WITH {DOCS}
SELECT path, source || '/' || lang AS parent_dir, doc_id || ext AS basename, ext, CAST(2 AS BIGINT) AS depth, size,
  CAST(size = 0 AS INTEGER) AS is_empty, {ISO} AS modified, CASE WHEN ext IN ('.py', '.js') THEN 'code' ELSE 'none' END AS class FROM docs"""

ORACLES["file_predicates"] = f"""WITH {DOCS}
SELECT path, size FROM docs WHERE ext IN ('.py', '.html') AND NOT contains(source, 'src1') AND NOT contains(path, '99')
  AND size BETWEEN 100 AND 50000 AND mtime >= TIMESTAMP '2024-01-03'"""

MANIFESTS = """tree AS (SELECT DISTINCT p_brand AS brand, p_type AS t, p_size AS z, p_partkey % 5 AS k,
  CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_partkey END AS one FROM part)"""

ORACLES["prune_and_allow"] = f"""WITH {MANIFESTS}
SELECT brand AS corpus_id, 'package.json' AS basename, count(*) AS n, CAST(sum(CASE k WHEN 0 THEN 2 WHEN 3 THEN 6 ELSE 3 END) AS BIGINT) AS depth_sum
FROM tree WHERE k <> 2 AND (t IN ('ECONOMY', 'PROMO') OR (t = 'STANDARD' AND z = 1)) GROUP BY 1"""

ORACLES["roots_table"] = f"""WITH {MANIFESTS}
SELECT brand AS corpus_id, 'package.json' AS basename, count(*) AS n, CAST(sum(CASE k WHEN 0 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 6 ELSE 3 END) AS BIGINT) AS depth_sum
FROM tree WHERE t IN ('ECONOMY', 'PROMO') OR (t = 'STANDARD' AND z = 1) GROUP BY 1"""

ORACLES["format_size"] = f"""WITH o AS (SELECT o_orderkey, CAST(floor(o_totalprice * pow(10, o_orderkey % 7 - 3)) AS BIGINT) AS size FROM orders)
SELECT o_orderkey, size, {SIZE_TEXT} AS shown FROM o"""

ORACLES["normalize_path"] = """SELECT DISTINCT '/base/a/s' || l_suppkey || '/p' || l_partkey || '.ts' AS path,
  'a/s' || l_suppkey || '/p' || l_partkey || '.ts' AS rel, '/base/a/s' || l_suppkey AS parent,
  'a/s' || l_suppkey || '/p' || l_partkey || '.ts' AS folded FROM lineitem"""

ORACLES["project_roots"] = f"""WITH {MANIFESTS},
hits AS (SELECT brand, t, z, one, k FROM tree WHERE k IN (0, 4)),
kept AS (SELECT * FROM hits h WHERE k = 0 OR NOT EXISTS
  (SELECT 1 FROM hits u WHERE u.k = 0 AND u.brand = h.brand AND u.t = h.t AND u.z = h.z)),
named AS (SELECT brand AS corpus_id, '/r/' || t || '/s' || z || CASE k WHEN 0 THEN '' ELSE '/p' || one END AS dir,
  CAST(CASE k WHEN 0 THEN 2 ELSE 3 END AS BIGINT) AS depth FROM kept)
SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY depth, dir) AS rank, dir, depth FROM named QUALIFY rank <= 5"""

ORACLES["alias_config"] = """WITH good AS (SELECT p_partkey AS k, p_brand FROM part WHERE p_partkey % 7 <> 0)
SELECT CAST(k AS VARCHAR) AS corpus_id, CAST(0 AS BIGINT) AS key_ord, '@p' || k || '/*' AS key, '@p' || k || '/' AS prefix, '' AS suffix,
  1 AS has_star, CAST(0 AS BIGINT) AS target_ord, 'parts/' || k || '/*' AS target, '/c' AS base_dir FROM good
UNION ALL SELECT CAST(k AS VARCHAR), 0, '@p' || k || '/*', '@p' || k || '/', '', 1, 1, 'alt/*', '/c' FROM good
UNION ALL SELECT CAST(k AS VARCHAR), 1, 'brand', 'brand', '', 0, 0, p_brand, '/c' FROM good"""

EXPECTED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "python": (".py", [
        ("specifier", "'os'"), ("specifier", "'parts.p' || p"), ("specifier", "'suppliers.s' || s"),
        ("import", "'from \"os\", kind=import'"), ("import", "'from \"parts.p' || p || '\", kind=import, alias=part'"),
        ("import", "'from \"suppliers.s' || s || '\", kind=from-import, names={name, account as acct}'"),
        ("export", "'kind=__all__, name=Item' || l"), ("export", "'kind=__all__, name=load'"),
        ("export", "'kind=class, name=Item' || l"), ("export", "'kind=def, name=load' || p"), ("function", "'load' || p"),
    ]),
    "rust": (".rs", [
        ("specifier", "'parts::{p' || p || ', q}'"), ("specifier", "'s' || s"),
        ("import", "'from \"parts::{p' || p || ', q}\", kind=use'"), ("import", "'from \"s' || s || '\", kind=extern-crate'"),
        ("export", "'kind=fn, name=load' || l || ', vis=pub(crate)'"), ("export", "'kind=struct, name=Item' || o || ', vis=pub'"),
        ("export", "'kind=const, name=LAST, vis=pub'"), ("function", "'load' || l || ', exported'"), ("function", "'inner' || p"),
    ]),
    "go": (".go", [
        ("specifier", "'fmt'"), ("specifier", "'parts/p' || p"), ("specifier", "'suppliers/s' || s"),
        ("import", "'from \"fmt\", kind=import'"), ("import", "'from \"parts/p' || p || '\", kind=import, alias=_'"),
        ("import", "'from \"suppliers/s' || s || '\", kind=import, alias=s' || l"),
        ("export", "'kind=const, name=Item' || l"), ("export", "'kind=type, name=Part' || p"),
        ("export", "'kind=var, name=Order' || o"), ("export", "'kind=func, name=Load' || l"),
        ("function", "'Load' || l"), ("function", "'local' || s"),
    ]),
    "java": (".java", [
        ("specifier", "'parts.P' || p"), ("specifier", "'suppliers.S' || s || '.*'"),
        ("import", "'from \"parts.P' || p || '\", kind=import'"), ("import", "'from \"suppliers.S' || s || '.*\", kind=import-static'"),
        ("export", "'kind=class, name=Item' || l"), ("export", "'kind=interface, name=Order' || o"),
    ]),
    "kotlin": (".kt", [
        ("specifier", "'parts.P' || p"), ("specifier", "'suppliers.S' || s"),
        ("import", "'from \"parts.P' || p || '\", kind=import, alias=Part' || l"), ("import", "'from \"suppliers.S' || s || '\", kind=import'"),
        ("export", "'kind=class, name=Item' || l"), ("export", "'kind=fun, name=load' || o"), ("export", "'kind=val, name=inner' || p"),
        ("function", "'load' || o"),
    ]),
    "csharp": (".cs", [
        ("specifier", "'System'"), ("specifier", "'Parts.P' || p"),
        ("import", "'from \"System\", kind=using'"), ("import", "'from \"Parts.P' || p || '\", kind=using-alias, alias=Part'"),
        ("export", "'kind=class, name=Item' || l || ', vis=public'"), ("export", "'kind=struct, name=Supp' || s || ', vis=internal'"),
    ]),
    "script": (".ts", [
        ("specifier", "'./types.d.ts'"), ("specifier", "'../../parts/p' || p"), ("specifier", "'../../suppliers/s' || s"),
        ("specifier", "'side-effect'"), ("specifier", "'logger'"), ("specifier", "'./lazy' || s"),
        ("import", "'from \"./types.d.ts\", kind=import, typeOnly=true'"),
        ("import", "'from \"../../parts/p' || p || '\", kind=import, default=part, named={name as label, Size}'"),
        ("import", "'from \"../../suppliers/s' || s || '\", kind=import, namespace=supp'"),
        ("import", "'from \"side-effect\", kind=side-effect'"), ("import", "'from \"logger\", kind=require, named={log as say}'"),
        ("import", "'from \"./lazy' || s || '\", kind=dynamic'"),
        ("export", "'kind=named, names={item' || l || '}'"), ("export", "'kind=named, names={label as order' || o || '}'"),
        ("export", "'kind=default, name=Item' || l"), ("export", "'kind=named, names={Shape' || s || '}'"),
        ("export", "'kind=cjs, target=module.exports.legacy'"),
        ("function", "'item' || l || ', exported'"), ("function", "'local' || p"),
    ]),
    "lexical": (".tsx", [
        ("specifier", "'../../parts/p' || p"), ("specifier", "'../../suppliers/s' || s"), ("specifier", "'in-markup' || p"),
        ("specifier", "'q' || o"), ("specifier", "'n' || s"), ("specifier", "'deep'"), ("specifier", "'end'"),
        ("import", "'from \"../../parts/p' || p || '\", kind=import, default=part'"),
        ("import", "'from \"../../suppliers/s' || s || '\", kind=import, named={y}'"),
        ("import", "'from \"in-markup' || p || '\", kind=require'"), ("import", "'from \"q' || o || '\", kind=import, default=q'"),
        ("import", "'from \"n' || s || '\", kind=require'"), ("import", "'from \"deep\", kind=dynamic'"), ("import", "'from \"end\", kind=dynamic'"),
        ("export", "'kind=named, names={view' || l || '}'"),
        ("function", "'view' || l || ', exported'"), ("function", "'last' || p"),
    ]),
    "declarators": (".ts", [
        ("specifier", "'../../parts/p' || p"), ("import", "'from \"../../parts/p' || p || '\", kind=require, default=z'"),
        ("export", "'kind=named, names={a' || l || '}'"), ("export", "'kind=named, names={b' || p || '}'"), ("export", "'kind=named, names={c}'"),
        ("export", "'kind=named, names={e}'"), ("export", "'kind=named, names={g}'"),
        ("specifier", "'eq' || o"), ("import", "'from \"eq' || o || '\", kind=import=, default=eq'"),
        ("function", "'b' || p || ', exported'"), ("function", "'y' || s"), ("function", "'v'"), ("function", "'outer'"), ("function", "'deep'"),
        ("function", "'after' || o"),
    ]),
}

for _lang, (_ext, _rows) in EXPECTED.items():
    ORACLES[f"extract_{_lang}"] = f"WITH {ITEMS} " + " UNION ALL ".join(
        f"SELECT 'items/i' || item || '{_ext}' AS path, '{_section}' AS section, {_sql} AS rendered FROM items"
        for _section, _sql in _rows
    )

_KINDS = {
    "python": {("specifier", "none"): 3, ("import", "import"): 2, ("import", "from-import"): 1, ("export", "__all__"): 2,
               ("export", "class"): 1, ("export", "def"): 1, ("function", "none"): 1},
    "rust": {("specifier", "none"): 2, ("import", "use"): 1, ("import", "extern-crate"): 1, ("export", "fn"): 1,
             ("export", "struct"): 1, ("export", "const"): 1, ("function", "none"): 2},
    "go": {("specifier", "none"): 3, ("import", "import"): 3, ("export", "const"): 1, ("export", "type"): 1, ("export", "var"): 1,
           ("export", "func"): 1, ("function", "none"): 2},
    "java": {("specifier", "none"): 2, ("import", "import"): 1, ("import", "import-static"): 1, ("export", "class"): 1,
             ("export", "interface"): 1},
    "kotlin": {("specifier", "none"): 2, ("import", "import"): 2, ("export", "class"): 1, ("export", "fun"): 1, ("export", "val"): 1,
               ("function", "none"): 1},
    "csharp": {("specifier", "none"): 2, ("import", "using"): 1, ("import", "using-alias"): 1, ("export", "class"): 1,
               ("export", "struct"): 1},
    "script": {("specifier", "none"): 6, ("import", "import"): 3, ("import", "side-effect"): 1, ("import", "require"): 1,
               ("import", "dynamic"): 1, ("export", "named"): 3, ("export", "default"): 1, ("export", "cjs"): 1, ("function", "none"): 2},
}
ORACLES["extract_counts"] = f"WITH {ITEMS}, n AS (SELECT count(*) AS n FROM items) " + " UNION ALL ".join(
    f"SELECT '{_lang}' AS lang, '{_section}' AS section, '{_kind}' AS kind, CAST({_times} * n AS BIGINT) AS n FROM n"
    for _lang, _counts in _KINDS.items()
    for (_section, _kind), _times in _counts.items()
)

ORACLES["extract_specifier_list"] = f"WITH {ITEMS}, spec AS (" + " UNION ALL ".join(
    f"SELECT item, {_sql} AS specifier FROM items" for _section, _sql in EXPECTED["script"][1] if _section == "specifier"
) + ") SELECT specifier, count(*) AS n, count(DISTINCT item) AS n_files FROM spec GROUP BY specifier"

SHOP = """items AS (SELECT DISTINCT l_returnflag AS flag, l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber AS l,
  'items/f' || l_linenumber || '/i' || l_orderkey || '_' || l_partkey || '_' || l_suppkey || '_' || l_linenumber || '.ts' AS rel FROM lineitem),
linked AS (SELECT *, 'parts/p' || p || CASE p % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.tsx' ELSE '.ts' END AS part_rel,
  'suppliers/s' || s || '.js' AS supp_rel FROM items)"""
RELATIVE_EDGES = """e AS (SELECT flag AS corpus_id, '/shop/' || rel AS src, '/shop/' || part_rel AS dst FROM linked
  UNION SELECT flag, '/shop/' || rel, '/shop/' || supp_rel FROM linked WHERE p % 2 = 0)"""
ALL_EDGES = RELATIVE_EDGES.replace(" WHERE p % 2 = 0", "")

ORACLES["edges"] = f"WITH {SHOP}, {RELATIVE_EDGES} SELECT corpus_id, src, dst FROM e"
ORACLES["alias_edges"] = f"WITH {SHOP}, {ALL_EDGES} SELECT corpus_id, src, dst FROM e"
ORACLES["in_degree_top"] = f"""WITH {SHOP}, {ALL_EDGES}, d AS (SELECT corpus_id, dst AS path, count(*) AS n FROM e GROUP BY 1, 2)
SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY n DESC, path) AS rank, path, n FROM d QUALIFY rank <= 10"""
ORACLES["out_degree_top"] = f"""WITH {SHOP}, {ALL_EDGES}, d AS (SELECT corpus_id, src AS path, count(*) AS n FROM e GROUP BY 1, 2)
SELECT corpus_id, row_number() OVER (PARTITION BY corpus_id ORDER BY n DESC, path) AS rank, path, n FROM d QUALIFY rank <= 10"""
ORACLES["edge_count"] = f"WITH {SHOP}, {ALL_EDGES} SELECT corpus_id, count(*) AS n_edges FROM e GROUP BY 1"
ORACLES["local_imports"] = f"""WITH {SHOP}
SELECT flag AS corpus_id, '/shop/' || rel AS path, '/shop/' || part_rel || ',/shop/' || supp_rel AS imports FROM linked"""
ORACLES["import_candidates"] = f"""WITH {SHOP}, flags AS (SELECT unnest(['A', 'N', 'R']) AS flag),
f AS (SELECT flag, 0 AS cand_ord FROM items
  UNION ALL SELECT flag, CASE p_partkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE 0 END FROM part, flags
  UNION ALL SELECT flag, 2 FROM supplier, flags)
SELECT flag AS corpus_id, CAST(cand_ord AS BIGINT) AS cand_ord, count(*) AS n FROM f GROUP BY 1, 2"""

_CONFIG = (
    '{ // aliases' + "' || chr(10) || '" + '  "compilerOptions": { "baseUrl": ".", "paths": { "@parts/*": ["gone/*", "parts/*"], '
    '"@supp/*": ["suppliers/*"] } } }'
)
ORACLES["explore_overview"] = f"""WITH {SHOP}, flags AS (SELECT unnest(['A', 'N', 'R']) AS flag),
named AS (SELECT *, CASE WHEN p % 2 = 0 THEN '../../suppliers/s' || s ELSE '@supp/s' || s END AS supp_spec FROM linked)
SELECT flag AS corpus_id, rel AS rel_path,
  strlen('import p from ''../../parts/p' || p || ''';' || chr(10) || 'import ''../../parts/missing' || p || ''';' || chr(10)
    || 'import s from ''' || supp_spec || ''';' || chr(10) || 'import again from ''../../parts/p' || p
    || '''; import dup from ''@parts/p' || p || ''';' || chr(10) || 'export const item = p;' || chr(10)) AS size,
  0 AS is_empty, '' AS file_type,
  'from "../../parts/p' || p || '", kind=import, default=p | from "../../parts/missing' || p || '", kind=side-effect | from "'
    || supp_spec || '", kind=import, default=s | from "../../parts/p' || p || '", kind=import, default=again | from "@parts/p'
    || p || '", kind=import, default=dup' AS imports,
  'kind=named, names={{item}}' AS exports, part_rel || ' | ' || supp_rel AS local_imports FROM named
UNION ALL SELECT flag, 'parts/p' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.tsx' ELSE '.ts' END,
  strlen('export default ''' || p_name || ''';' || chr(10)), 0, '', '', 'kind=default', '' FROM part, flags
UNION ALL SELECT flag, 'suppliers/s' || s_suppkey || '.js', 0, 1, '', '', '', '' FROM supplier, flags
UNION ALL SELECT flag, 'tsconfig.json', strlen('{_CONFIG}'), 0, 'config', '', '', '' FROM flags"""

ORACLES["explore_sub_dir"] = "SELECT corpus_id, '/shop/build' AS root, rel_path, size, local_imports FROM (" + ORACLES["explore_overview"] + ")"

SCORE = """levenshtein(q, c) - CASE WHEN starts_with(c, q) THEN least(3, length(q)) ELSE 0 END - CASE WHEN contains(c, q) THEN 1 ELSE 0 END"""

ORACLES["suggest_topk"] = f"""WITH asked AS (SELECT unnest(['customer#00000001', 'Custmer#000000123', ' ustomer#00000007 ', 'supplier', '#0000004']) AS query),
pairs AS (SELECT query, c_name AS candidate, lower(trim(query)) AS q, lower(trim(c_name)) AS c FROM asked, (SELECT DISTINCT c_name FROM customer)),
scored AS (SELECT query, candidate, {SCORE} AS score FROM pairs)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score, candidate) AS rank, candidate, score FROM scored QUALIFY rank <= 5"""

ORACLES["suggest_table"] = f"""WITH asked AS (SELECT DISTINCT lower(c_mktsegment) || 's' AS query FROM customer),
names AS (SELECT c_name AS candidate FROM customer UNION SELECT c_mktsegment FROM customer),
pairs AS (SELECT query, candidate, query AS q, lower(trim(candidate)) AS c FROM asked, names),
scored AS (SELECT query, candidate, {SCORE} AS score FROM pairs)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score, candidate) AS rank, candidate, score FROM scored QUALIFY rank <= 3"""

ORACLES["edit_distances"] = f"""WITH w AS (SELECT DISTINCT p_name, p_type, lower(split_part(p_name, ' ', 1)) AS q, lower(p_name) AS c FROM part)
SELECT p_name, p_type, levenshtein(lower(p_name), lower(p_type)) AS distance, {SCORE} AS score FROM w"""

ENTRIES = """entries AS (SELECT c_custkey AS k, c_custkey // 10 AS g, c_custkey % 4 IN (0, 1) AS is_dir,
  CASE WHEN c_custkey % 4 IN (0, 1) THEN 'd' || c_custkey ELSE 'file_' || c_custkey || '.json' END AS name FROM customer)"""

ORACLES["suggest_paths"] = f"""WITH {ENTRIES},
pairs AS (SELECT r.c_custkey AS request_id, e.name, 'c/g' || e.g || '/' || e.name AS suggestion, 'fil_' || r.c_custkey || '.jsn' AS q, lower(e.name) AS c
  FROM customer r JOIN entries e ON e.g = r.c_custkey // 10),
scored AS (SELECT request_id, name, suggestion, {SCORE} AS score FROM pairs)
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY score, name) AS rank, suggestion, score FROM scored QUALIFY rank <= 3"""

ORACLES["suggest_project"] = f"""WITH {ENTRIES},
pairs AS (SELECT r.c_custkey AS request_id, e.name, 'c/g' || e.g || '/' || e.name AS suggestion, 'd' || r.c_custkey AS q, lower(e.name) AS c
  FROM customer r JOIN entries e ON e.g = r.c_custkey // 10 WHERE e.is_dir),
scored AS (SELECT request_id, name, suggestion, {SCORE} AS score FROM pairs),
near AS (SELECT request_id, 0 AS origin, row_number() OVER (PARTITION BY request_id ORDER BY score, name) AS place, suggestion FROM scored QUALIFY place <= 5),
both_kinds AS (SELECT * FROM near UNION ALL
  SELECT c_custkey, 1, 1, 'c/g' || c_custkey // 10 || '/d' || c_custkey || CASE c_custkey % 4 WHEN 1 THEN '/sub' ELSE '' END
  FROM customer WHERE c_custkey % 4 IN (0, 1))
SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY origin, place) AS rank, suggestion FROM both_kinds QUALIFY rank <= 5"""

_MEANT = "coalesce(' Did you mean: ' || string_agg(suggestion, ', ' ORDER BY rank) || '?', '') AS hint"
for _asker, _before, _after in (
    ("search", "'The path '''", "''' does not exist or cannot be accessed.'"),
    ("explore", "'The path '''", "''' does not exist or is not a directory.'"),
):
    ORACLES[f"{_asker}_missing"] = f"""WITH {ENTRIES}, asked AS (SELECT c_custkey AS request_id, c_custkey // 10 AS g FROM customer WHERE c_custkey % 4 NOT IN (0, 1)),
pairs AS (SELECT request_id, name, 'c/g' || e.g || '/' || e.name AS suggestion, 'd' || request_id AS q, lower(e.name) AS c
  FROM asked r JOIN entries e ON e.g = r.g WHERE e.is_dir),
near AS (SELECT request_id, suggestion, row_number() OVER (PARTITION BY request_id ORDER BY {SCORE}, name) AS rank FROM pairs QUALIFY rank <= 5),
hints AS (SELECT request_id, {_MEANT} FROM near GROUP BY 1)
SELECT request_id, {_before} || 'c/g' || g || '/d' || request_id || {_after} || coalesce(hint, '') AS message FROM asked LEFT JOIN hints USING (request_id)"""
for _asker, _before, _after in (("rename", "'Source path \"'", "'\" does not exist.'"), ("delete", "'Path \"'", "'\" does not exist.'")):
    ORACLES[f"{_asker}_missing"] = f"""WITH near AS ({ORACLES["suggest_paths"].replace("rank <= 3", "rank <= 5")}),
hints AS (SELECT request_id, {_MEANT} FROM near GROUP BY 1)
SELECT c_custkey AS request_id, {_before} || 'c/g' || c_custkey // 10 || '/fil_' || c_custkey || '.jsn' || {_after} || coalesce(hint, '') AS message
FROM customer LEFT JOIN hints ON request_id = c_custkey"""
ORACLES["outdated_missing"] = f"""WITH near AS ({ORACLES["suggest_project"]}),
hints AS (SELECT request_id, {_MEANT} FROM near GROUP BY 1)
SELECT c_custkey AS request_id, 'package.json not found in "c/g' || c_custkey // 10 || '/d' || c_custkey || '".' || coalesce(hint, '') AS message
FROM customer LEFT JOIN hints ON request_id = c_custkey WHERE c_custkey % 4 <> 0"""

RUNS = """runs AS (SELECT p_partkey AS k, p_partkey % 10 AS r, p_size AS z, '/projects/p' || p_partkey AS project FROM part),
rows AS (
  SELECT k, project, 'part' || k AS package, '1.' || z AS current, '2.0' AS wanted, '3.0' AS latest, project AS location,
    CASE k % 2 WHEN 0 THEN 'devDependencies' ELSE 'dependencies' END AS type FROM runs WHERE r IN (0, 2, 3, 4, 5, 6, 7)
  UNION ALL SELECT k, project, 'brand', 'unknown', 'unknown', '9', '/m/' || k, 'dependencies' FROM runs WHERE r IN (0, 2, 3, 4, 5, 6, 7)
  UNION ALL SELECT k, project, 'list', 'unknown', 'unknown', 'unknown', project, 'dependencies' FROM runs WHERE r IN (0, 2, 3, 4, 5, 6, 7))"""

ORACLES["outdated_rows"] = f"WITH {RUNS} SELECT project, package, current, wanted, latest, location, type FROM rows"
ORACLES["outdated_production"] = f"WITH {RUNS} SELECT project, package, type FROM rows WHERE type <> 'devDependencies'"
ORACLES["outdated_by_type"] = f"WITH {RUNS} SELECT project, type, count(*) AS n FROM rows GROUP BY 1, 2"
ORACLES["outdated_summary"] = f"""WITH {RUNS}, f AS (SELECT project, r IN (0, 2, 3, 4, 5, 6, 7) AS good FROM runs)
SELECT project, CAST(CASE WHEN good THEN 5 ELSE 0 END AS BIGINT) AS n_checked, CAST(CASE WHEN good THEN 3 ELSE 0 END AS BIGINT) AS n_outdated,
  CAST(good AS INTEGER) AS has_outdated FROM f"""
ORACLES["report_status"] = f"""WITH {RUNS}
SELECT project, CASE WHEN k % 20 = 19 THEN 'missing_manifest' WHEN r = 1 THEN 'ok' WHEN r < 8 THEN 'outdated' WHEN r = 8 THEN 'failed'
  WHEN k % 4 = 1 THEN 'command_missing' WHEN k % 8 = 3 THEN 'timeout' WHEN k % 8 = 7 THEN 'bad_directory' ELSE 'failed' END AS status FROM runs"""
ORACLES["outdated_detailed"] = f"""WITH {RUNS}, shown AS (SELECT project, k, r IN (0, 2, 3, 4, 5, 6, 7) AS good FROM runs WHERE r < 8),
placed AS (SELECT *, 7 + 6 * CASE package WHEN 'brand' THEN 1 WHEN 'list' THEN 2 ELSE 0 END AS pos FROM rows)
SELECT project, CAST(0 AS BIGINT) AS ord, '# NPM Outdated Check Results' AS line FROM shown
UNION ALL SELECT project, 1, '' FROM shown
UNION ALL SELECT project, 2, '**Project:** ' || project || '/package.json' FROM shown
UNION ALL SELECT project, 3, '**Total Packages Checked:** ' || CASE WHEN good THEN 5 ELSE 0 END FROM shown
UNION ALL SELECT project, 4, '' FROM shown
UNION ALL SELECT project, 5, CASE WHEN good THEN 'Found 3 outdated packages:' ELSE 'All packages are up to date! 🎉' END FROM shown
UNION ALL SELECT project, 6, '' FROM shown WHERE good
UNION ALL SELECT project, pos, '📦 ' || package FROM placed
UNION ALL SELECT project, pos + 1, '   Current: ' || current FROM placed
UNION ALL SELECT project, pos + 2, '   Wanted:  ' || wanted FROM placed
UNION ALL SELECT project, pos + 3, '   Latest:  ' || latest FROM placed
UNION ALL SELECT project, pos + 4, '   Type:    ' || type FROM placed
UNION ALL SELECT project, pos + 5, '' FROM placed
UNION ALL SELECT project, 25, 'Run ''npm update'' to update to wanted versions or ''npm install <package>@latest'' for latest versions.' FROM shown WHERE good"""

ORACLES["outdated_text"] = f"""WITH {RUNS}, shown AS (SELECT project, k, r IN (0, 2, 3, 4, 5, 6, 7) AS good FROM runs WHERE r < 8)
SELECT project, CAST(0 AS BIGINT) AS ord, '# NPM Outdated Check Results' AS line FROM shown
UNION ALL SELECT project, 1, '' FROM shown
UNION ALL SELECT project, 2, '**Project:** ' || project || '/package.json' FROM shown
UNION ALL SELECT project, 3, '**Total Packages Checked:** ' || CASE WHEN good THEN 5 ELSE 0 END FROM shown
UNION ALL SELECT project, 4, '' FROM shown
UNION ALL SELECT project, 5, CASE WHEN good THEN 'Found 3 outdated packages' ELSE 'All packages are up to date! 🎉' END FROM shown
UNION ALL SELECT project, 6, '' FROM shown WHERE good
UNION ALL SELECT project, 7, 'Breakdown by type:' FROM shown WHERE good
UNION ALL SELECT project, 8, CASE k % 2 WHEN 0 THEN '- devDependencies: 1' ELSE '- dependencies: 3' END FROM shown WHERE good
UNION ALL SELECT project, 9, '- dependencies: 2' FROM shown WHERE good AND k % 2 = 0"""

ORACLES["rename_paths"] = """WITH n AS (SELECT p_size AS size, CASE
  WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '/' || p_brand || '/' || p_type || '/q' || p_partkey || '.ts'
  WHEN p_partkey % 3 = 0 THEN '/' || p_brand || '/moved/p' || p_partkey || '.ts'
  WHEN p_type = 'PROMO' THEN '/' || p_brand || '/OLD/p' || p_partkey || '.ts'
  ELSE '/' || p_brand || '/' || p_type || '/p' || p_partkey || '.ts' END AS path FROM part)
SELECT path, substring(path, 2) AS rel_path, CAST(size AS BIGINT) AS size FROM n"""

ORACLES["rename_contents"] = """SELECT CASE
  WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '/' || p_brand || '/' || p_type || '/q' || p_partkey || '.ts'
  WHEN p_partkey % 3 = 0 THEN '/' || p_brand || '/moved/p' || p_partkey || '.ts'
  WHEN p_type = 'PROMO' THEN '/' || p_brand || '/OLD/p' || p_partkey || '.ts'
  ELSE '/' || p_brand || '/' || p_type || '/p' || p_partkey || '.ts' END AS path, md5(p_name) AS digest FROM part"""
ORACLES["rename_chain"] = """SELECT '/' || p_brand || CASE WHEN p_partkey % 4 = 0 THEN '/chain/c' WHEN p_type = 'PROMO' THEN '/NEW/deep/p' ELSE '/' || p_type || '/p' END
  || p_partkey || '.ts' AS path, md5(p_name) AS digest FROM part"""
ORACLES["rename_chain_status"] = """WITH s AS (SELECT *, '/' || p_brand || '/' || p_type AS stem, '/' || p_brand AS brand FROM part),
asked AS (
  SELECT p_partkey * 10 + 1 AS request_id, stem || '/p' || p_partkey || '.ts' AS old_path, stem || '/t' || p_partkey || '.ts' AS new_path, 'rename' AS status FROM s WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey * 10 + 2, stem || '/t' || p_partkey || '.ts', brand || '/chain/c' || p_partkey || '.ts', 'move' FROM s WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey * 10 + 1, stem || '/p' || p_partkey || '.ts', stem || '/w' || p_partkey || '.ts', 'rename' FROM s WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey * 10 + 2, stem || '/p' || p_partkey || '.ts', stem || '/v' || p_partkey || '.ts', 'source_missing' FROM s WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey * 10 + 3, stem || '/w' || p_partkey || '.ts', stem || '/p' || p_partkey || '.ts', 'rename' FROM s WHERE p_partkey % 4 = 1
  UNION ALL SELECT p_partkey * 10 + 1, stem || '/p' || p_partkey || '.ts', stem || '/p' || p_partkey || '.ts', 'destination_exists' FROM s WHERE p_partkey % 4 = 2
  UNION ALL SELECT 1000000000000 + CAST(substring(p_brand, 7) AS BIGINT) * 10 + n, brand || CASE n WHEN 0 THEN '/PROMO' ELSE '/OLD' END,
    brand || CASE n WHEN 0 THEN '/OLD' ELSE '/NEW/deep' END,
    CASE WHEN NOT bool_or(p_partkey % 4 <> 0) THEN 'source_missing' WHEN n = 0 THEN 'rename' ELSE 'move' END
  FROM s, range(2) AS steps(n) WHERE p_type = 'PROMO' GROUP BY p_brand, brand, n)
SELECT request_id, old_path, new_path, status FROM asked"""

ORACLES["rename_status"] = """WITH r AS (
  SELECT p_partkey AS request_id, p_brand, p_partkey % 3 = 0 AS present, p_partkey % 2 = 0 AS same_dir,
    '/' || p_brand || '/' || p_type || CASE p_partkey % 3 WHEN 0 THEN '/p' ELSE '/x' END || p_partkey || '.ts' AS old_path,
    '/' || p_brand || CASE p_partkey % 2 WHEN 0 THEN '/' || p_type || '/q' ELSE '/moved/p' END || p_partkey || '.ts' AS new_path
  FROM part WHERE p_partkey % 3 <> 2
  UNION ALL SELECT DISTINCT 1000000000000 + CAST(substring(p_brand, 7) AS BIGINT), p_brand, true, true, '/' || p_brand || '/PROMO', '/' || p_brand || '/OLD'
  FROM part WHERE p_type = 'PROMO')
SELECT request_id, old_path, new_path, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'source_outside'
  WHEN NOT present THEN 'source_missing' WHEN same_dir THEN 'rename' ELSE 'move' END AS status FROM r"""

ORACLES["delete_paths"] = """SELECT '/' || p_brand || '/' || p_type || '/p' || p_partkey || '.ts' AS path, CAST(p_size AS BIGINT) AS size
FROM part WHERE p_partkey % 4 <> 0 AND p_type <> 'PROMO'"""

ORACLES["delete_contents"] = """SELECT '/' || p_brand || '/' || p_type || '/p' || p_partkey || '.ts' AS path, md5(p_name) AS digest
FROM part WHERE p_partkey % 4 <> 0 AND p_type <> 'PROMO'"""

ORACLES["delete_status"] = """WITH r AS (
  SELECT p_partkey AS request_id, p_brand, '/' || p_brand || '/' || p_type || CASE p_partkey % 4 WHEN 0 THEN '/p' || p_partkey || '.ts' ELSE '/gone' || p_partkey END AS path,
    CASE p_partkey % 4 WHEN 0 THEN 'deleted_file' ELSE 'missing' END AS status FROM part WHERE p_partkey % 4 <> 3
  UNION ALL SELECT DISTINCT 1000000000000 + CAST(substring(p_brand, 7) AS BIGINT) * 100 + length(p_type), p_brand, '/' || p_brand || '/' || p_type,
    CASE p_type WHEN 'PROMO' THEN 'deleted_directory' ELSE 'not_empty' END FROM part)
SELECT request_id, path, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN status ELSE 'outside' END AS status FROM r"""

ORACLES["latest_events"] = "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"
ORACLES["latest_events_per_user"] = """SELECT event_id, user_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20"""
