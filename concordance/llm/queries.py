"""The queries of this subpackage over the tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .embeddings import near_duplicates as similar_vectors
from .languages import identify
from .merkle import edits
from .mixing import mixed
from .packing import pack
from .simhash import near_duplicates
from .token_counts import count_tokens
from .token_files import token_output
from .toxicity import toxicity
from .url_filters import Rule, judge


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(parts: int, which: int) -> Column:
    """Whether crc32 of the document id as text, modulo ``parts``, is ``which``; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0))
    return toxicity(docs, docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"), keep=("held_out",))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixed(docs, temperature=0.5, seed="mix", copy_col="copy", key_col="order_key")
    return out.select("doc_id", "source", "copy", "order_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


#: The rules of op5, fixed by its contract.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), [Rule.of(*x) for x in URL_RULES])


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(4, 2))
    out = identify(docs, docs.filter(~F.col("held_out")), keep=("held_out",))
    return out.select("doc_id", "held_out", "lang_pred", "score", "rate")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"), least_cosine=0.98)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_mixing, op4_token_files, op5_url_filters, op6_fingerprints, op7_languages, op8_embeddings, op9_packing, op10_token_counts)}


MIXING_SQL = """
WITH RECURSIVE docs AS (SELECT doc_id::VARCHAR AS id, doc_id, source, coalesce('s' || source, 'null') AS src, md5(coalesce(text, '')) AS text_md5 FROM documents),
  sizes AS (SELECT src, count(*)::DOUBLE AS size, pow(count(*)::DOUBLE, 0.5) AS weight FROM docs GROUP BY src),
  totals AS (SELECT sum(size) AS size, sum(weight) AS weight FROM sizes),
  rates AS (SELECT src, s.weight / t.weight * t.size / s.size AS rate FROM sizes s, totals t),
  means AS (SELECT src, greatest(1, ceil(rate / 8.0))::INT AS steps, rate / greatest(1, ceil(rate / 8.0)) AS mean FROM rates),
  below(src, j, mean, term, total) AS (SELECT src, 0, mean, exp(-mean), exp(-mean) FROM means
    UNION ALL SELECT src, j + 1, mean, term * mean / (j + 1), total + term * mean / (j + 1) FROM below WHERE j < 63),
  draws AS (SELECT d.*, i, ('0x' || substr(md5('mix|n|' || coalesce(id, '') || '|' || i), 1, 13))::BIGINT / 4503599627370496.0 AS u
    FROM docs d JOIN means m USING (src), range(1, 1000) t(i) WHERE i <= m.steps),
  counts AS (SELECT doc_id, id, source, text_md5, sum((SELECT count(*) FROM below b WHERE b.src = draws.src AND draws.u >= b.total)) AS n FROM draws GROUP BY ALL),
  copies AS (SELECT doc_id, id, source, text_md5, unnest(range(0, n::BIGINT)) AS copy FROM counts)
SELECT doc_id, source, copy::INT AS copy, ('0x' || substr(md5('mix|order|' || coalesce(id, '') || '|' || copy), 1, 13))::BIGINT / 4503599627370496.0 AS order_key, text_md5 FROM copies
"""


def _tree_sql(text: str) -> str:
    clauses = "string_split(regexp_replace(p, '([.!?,;|]) ', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform({clauses}, lambda x: sha256(x))))"


def _fingerprint_sql(tree: str) -> str:
    root = f"sha256(array_to_string(list_transform({tree}, lambda s: sha256(array_to_string(list_transform(s, lambda p: sha256(array_to_string(p, ''))), ''))), ''))"
    shown = f"array_to_string(list_transform({tree}, lambda s: array_to_string(list_transform(s, lambda p: array_to_string(list_transform(p, lambda x: substr(x, 1, 12)), ',')), '/')), ';')"
    return f"{root} || '|' || {shown}"


def _likeness_sql(a: str, b: str) -> str:
    leaves = "list_distinct(string_split_regex(substr({}, 66), '[,/;]'))"
    x, y = leaves.format(a), leaves.format(b)
    return f"CASE WHEN left({a}, 64) = left({b}, 64) THEN 1.0::DOUBLE ELSE 2.0 * len(list_intersect({x}, {y})) / (len({x}) + len({y})) END"


FINGERPRINTS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  n AS (SELECT doc_id, text, length(text)::BIGINT AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d WINDOW w AS (ORDER BY doc_id, text)),
  e AS (SELECT *, left(text, n_chars - n_chars // 2) || left(next_text, n_chars // 2) AS edited FROM n),
  t AS (SELECT doc_id, n_chars, edited, {_tree_sql("text")} AS a, {_tree_sql("edited")} AS b, {_tree_sql("next_text")} AS c FROM e),
  f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_fingerprint_sql("a")} AS fingerprint, {_fingerprint_sql("b")} AS edited_fingerprint, {_fingerprint_sql("c")} AS next_fingerprint FROM t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, {_likeness_sql("fingerprint", "edited_fingerprint")} AS near_edited, {_likeness_sql("fingerprint", "next_fingerprint")} AS near_next FROM f
"""

EMBEDDINGS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT p.b, reach.r FROM reach JOIN p ON p.a = reach.id),
  c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = v.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON c.id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL can express; the others are tested against brute force in tests/llm."""
    return {"op3_mixing": MIXING_SQL, "op6_fingerprints": FINGERPRINTS_SQL, "op8_embeddings": EMBEDDINGS_SQL}
