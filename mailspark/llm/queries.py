"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, simhash_dedup
from .alignment import align
from .best_fit import pack_best_fit
from .common import table
from .line_dedup import line_classes
from .lm_scoring import crc_mod, score_documents
from .mixing import mix
from .packing import pack
from .quality_classifier import score_quality
from .quality_rules import judge
from .spelling_variants import spelling_variants
from .substring_dedup import remove_repeats
from .url_filter import host_and_path, url_verdicts

#: Fixed values of the URL query.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: A host label that holds one of these as a hyphenated part is put on the list.
LISTED_LABEL_PARTS = ("spam", "pills", "casino", "xxx", "warez", "loans")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # a host's shortest key with such a label: hosts below it are below its longer ones or beside them
    part = rf"(?s)^(?:.*\.)?((?:[^.]*-)?(?:{'|'.join(LISTED_LABEL_PARTS)})(?:-[^.]*)?(?:\..*)?)\z"
    hosts = host_and_path(pages).select("host").distinct()
    listed = hosts.select(F.regexp_extract("host", part, 1).alias("key")).where("key <> ''").distinct()
    return url_verdicts(pages, URL_RULES, listed)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1, 's') AS path FROM u
), r(rh, rp, rule, rv) AS (
  VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'),
         ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')
), best AS (
  SELECT p.page_id, max(struct_pack(n := length(rule), rule := rule, rv := rv)) AS b
  FROM (SELECT DISTINCT * FROM p) p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY p.page_id
), j AS (
  SELECT p.page_id, host, path, b.rule AS rule, b.rv AS rv,
         regexp_matches(host, '(^|[.-])(spam|pills|casino|xxx|warez|loans)([.-]|$)') AS listed
  FROM p LEFT JOIN best USING (page_id)
)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM j
"""

def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "fingerprint", "component_id"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), wins AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM twice, range(5) r(k)) GROUP BY doc_id
), c AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), r AS (
  SELECT *, word_chars / greatest(n_words, 1) AS a, n_symbols / greatest(n_words, 1) AS b, n_dup_lines / greatest(n_lines, 1) AS d,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM c
), o AS (
  SELECT lang, source, list_sort(list(a)) AS a, list_sort(list(b)) AS b, list_sort(list(d)) AS d,
         greatest(1, ceil(0.25 * count(*)))::BIGINT AS i, greatest(1, ceil(0.75 * count(*)))::BIGINT AS j
  FROM r WHERE n_words > 0 GROUP BY lang, source
), f AS (
  SELECT lang, source, a[j] + greatest(3 * (a[j] - a[i]), 2.0::DOUBLE) AS a_max, a[i] - greatest(3 * (a[j] - a[i]), 2.0::DOUBLE) AS a_min,
         b[j] + greatest(3 * (b[j] - b[i]), 0.1::DOUBLE) AS b_max, d[j] + greatest(3 * (d[j] - d[i]), 0.5::DOUBLE) AS d_max
  FROM o
)
SELECT r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
       NOT r.base_failed AND coalesce(r.a <= f.a_max AND r.a >= f.a_min AND r.b <= f.b_max AND r.d <= f.d_max, false) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents")).drop("th")


# DuckDB's levenshtein counts bytes, as the operator does.
OP6_SQL = r"""
WITH RECURSIVE p AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
), l AS (
  SELECT doc_id, (i - 1)::INTEGER AS line_no, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)
), u AS (
  SELECT s, strlen(s) AS n, row_number() OVER (ORDER BY s) AS id, min(struct_pack(doc_id := doc_id, line_no := line_no)) AS f
  FROM l WHERE s <> '' GROUP BY s
), m AS MATERIALIZED (
  SELECT id, s, n, n + k AS k FROM u, range(3) r(k) WHERE n >= 20
), e AS MATERIALIZED (
  SELECT a.id AS x, b.id AS y FROM m a JOIN (SELECT * FROM m WHERE k = n) b ON a.k = b.n
  WHERE CASE WHEN a.id <> b.id THEN levenshtein(a.s, b.s) <= 2 ELSE false END
), g AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r AS (
  SELECT x, y FROM g UNION SELECT r.x, g.y FROM r JOIN g ON r.y = g.x
), c AS (
  SELECT u.s, least(u.f, min(v.f)) AS f FROM u LEFT JOIN r ON r.x = u.id LEFT JOIN u v ON v.id = r.y GROUP BY u.s, u.f
)
SELECT doc_id, line_no, c.f.doc_id AS class_doc_id, c.f.line_no AS class_line_no,
       doc_id = c.f.doc_id AND line_no = c.f.line_no AS kept
FROM l JOIN c USING (s)
"""


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = crc_mod(F.col("doc_id"), 10)
    return score_documents(table(spark, sf_dir, "documents"), train=part != 0, held_out=part == 0)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken"
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def piece_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_tokenizer_path())


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_source_mixing": op9_source_mixing,
    "op10_packing": op10_packing,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_best_fit_packing": op13_best_fit_packing,
}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op4_quality_rules": OP4_SQL, "op6_line_dedup": OP6_SQL}
