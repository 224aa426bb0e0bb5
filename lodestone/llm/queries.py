"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chunk_codec import encode_and_decode
from lodestone.llm.class_lm import score_corpus
from lodestone.llm.collocations import collocations
from lodestone.llm.decontaminate import find_contamination, hit_words
from lodestone.llm.filter_audit import audit_filters
from lodestone.llm.language_id import identify_languages, learnable, train
from lodestone.llm.longest_match import count_pieces
from lodestone.llm.main_text import extract_main_text
from lodestone.llm.near_dedup import near_duplicates
from lodestone.llm.pivot_index import near_duplicate_vectors
from lodestone.llm.repair_store import read_store, write_store
from lodestone.llm.shards import assign_shards
from lodestone.llm.url_cascade import Rule, judge_urls, url_host, url_path
from lodestone.materialize import shared_folder

SHARDS = 40
#: The rules that the url query is asked for.
URL_RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)
#: Phrases that the collocation query gives for each language.
PHRASES = 2_000
#: Host labels whose pages make up the list of keys in the url query.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> bytes:
    """A public tokenizer's file, read by the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")


def op2_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words("hit_spans").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json").decode())


def op6_repair_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    vocabulary = tokenizer_file("byte_bpe_50k.json").decode()
    write_store(table(spark, sf_dir, "documents"), path, vocabulary, end_id=2, special_in_text=True)
    return read_store(spark, path)


def op7_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    on_list = F.arrays_overlap(F.split(host, "\\."), F.array(*map(F.lit, LISTED_LABELS)))
    listed = pages.filter(on_list).select(F.concat(host, path).alias("key"))
    return judge_urls(pages, URL_RULES, listed)


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op9_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"), PHRASES)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_network": op1_byte_network,
    "op2_wu_manber": op2_wu_manber,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_class_bigrams": op4_class_bigrams,
    "op5_longest_match": op5_longest_match,
    "op6_repair_store": op6_repair_store,
    "op7_url_cascade": op7_url_cascade,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_pivot_index": op9_pivot_index,
    "op10_chunk_table": op10_chunk_table,
    "op11_phrase_index": op11_phrase_index,
    "op12_term_matrix": op12_term_matrix,
    "op13_tree_scoring": op13_tree_scoring,
}

ORACLES: dict[str, str] = {
    "op7_url_cascade": """
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
""",
    "op2_wu_manber": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), placed AS (
  SELECT rid, k, i, array_to_string(w[i : i + k - 1], ' ') AS p
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), found AS (
  SELECT rid, i, k, item FROM placed JOIN windows USING (k, p)
), hit AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS place FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
""",
    "op3_circulant_minhash": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), pairs AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS both_sets FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * both_sets >= 85 * (x.n + y.n - both_sets)
), reach(rid, other) AS (
  SELECT rid, rid FROM docs UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (
  SELECT reach.rid, min(d.doc_id) AS component_id FROM reach JOIN docs d ON d.rid = other GROUP BY 1
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN components USING (rid) LEFT JOIN sizes USING (rid)
""",
    "op9_pivot_index": """
WITH RECURSIVE all_rows AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), vectors AS (
  SELECT *, sqrt(list_inner_product(e, e)) AS norm FROM all_rows
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.rid AS a, b.rid AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(rid, other) AS (
  SELECT rid, rid FROM all_rows UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.other
), components AS (
  SELECT reach.rid, min(v.vec_id) AS component_id FROM reach JOIN all_rows v ON v.rid = other GROUP BY 1
), counts AS (
  SELECT a AS rid, count(*) AS n FROM links GROUP BY 1
)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM all_rows JOIN components USING (rid) LEFT JOIN counts USING (rid)
""",
    "op11_phrase_index": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS sizes(k) WHERE len(w) >= k
  )
), counted AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counted WHERE k > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT s.lang, inner_phrase AS phrase FROM (
    SELECT c.lang, unnest([array_to_string(w[1 : k - 1], ' '), array_to_string(w[2 : k], ' ')]) AS inner_phrase, a FROM candidates c WHERE k > 2
  ) x JOIN candidates s ON s.lang = x.lang AND s.phrase = inner_phrase AND 100 * x.a >= 100 * s.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, array_to_string(w[1 : cut], ' ') AS first, array_to_string(w[cut + 1 : k], ' ') AS rest
  FROM candidates c, range(1, 5) AS cutting(cut) WHERE cut < k AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase)
), scored AS (
  SELECT c.lang, c.phrase, c.a, cut, p.f AS l, q.f AS r, n, 1000 * CAST(c.a AS HUGEINT) * n // (CAST(p.f AS HUGEINT) * q.f) AS score
  FROM cuts c JOIN counted p ON p.lang = c.lang AND p.phrase = first JOIN counted q ON q.lang = c.lang AND q.phrase = rest JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
""",
    "op12_term_matrix": r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, part,
    (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS failed
  FROM words
), own AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged LEFT JOIN own USING (doc_id) GROUP BY part, failed
), letters(x, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND (p.b | q.b | r.b | s.b | t.b) = 31
), places AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS steps(step)
)
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN (failed & (before | bit)) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN (failed & bit) > 0 AND (failed & before) = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN (failed & bit) > 0 AND (failed & before) > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN (failed & bit) > 0 AND (failed & before) = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN (failed & bit) > 0 AND (failed & before) = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN (failed & bit) > 0 THEN n * (120 // bit_count(failed)) ELSE 0 END) AS BIGINT) AS shapley
FROM counts, places GROUP BY part, filter_order, step
""",
}
