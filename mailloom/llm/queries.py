"""Queries of the llm operators: name -> function of (spark, folder with the tables); SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import encodings, leakage, lookalikes, mixing, near_duplicates, own_text, stuffing
from mailloom.plans.storage import read

#: Problem 3 in this project's data: runs of three words, similarity 0.6, at least 40 words.
P3 = dict(k=3, similarity=0.6, least=40)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # one row per value, as email_id is unique
    return p1_restored(spark, d).select("email_id", "field")


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.restore_fields(read(spark, d, "parse_eml"), "email_id", ["subject", "body"], encodings.train(read(spark, d, "documents")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return own_text.not_own_lines(read(spark, d, "parse_eml"))


def p4_own_text(spark: SparkSession, d: str) -> DataFrame:
    return own_text.own_text(read(spark, d, "parse_eml"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    model = encodings.train(read(spark, d, "documents"))
    return lookalikes.find_cases(read(spark, d, "parse_eml"), "email_id", ["from_addr", "body"], model, ["body"]).select("email_id", "field")


def p5_one_form(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.one_form(read(spark, d, "parse_eml"), "email_id", ["from_addr", "body"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(read(spark, d, "parse_eml"), **P3)


def p3_link_counts(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.link_counts(read(spark, d, "parse_eml"), **P3)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read(spark, d, "documents"), read(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaked(read(spark, d, "documents"), read(spark, d, "eval_items")).withColumn("received_at", F.unix_micros("received_at"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p8_rates_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """The rates of the mixture with characters for tokens."""
    sizes = read(spark, d, "documents").join(read(spark, d, "mix_targets").select("source").distinct(), "source", "left_semi").select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_tokens"))
    return mixing.rates(sizes, read(spark, d, "mix_targets")).select("source", "n_docs", "size", F.col("total").cast("bigint").alias("total"), F.round("rate", 9).alias("rate"))


def p9_links_and_tags(spark: SparkSession, d: str) -> DataFrame:
    """Words, links and tags as problem 9 counts them."""
    return stuffing.score_pages(read(spark, d, "documents")).select("doc_id", "words", F.round("link_share", 9).alias("link_share"), F.round("tag_share", 9).alias("tag_share"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed_pages(read(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.score_pages(read(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_restored, p4_found, p4_own_text, p5_found, p5_one_form, p3_found, p3_link_counts, p7_found, p7_leaks, p7_clean, p8_mixture, p8_shares, p8_rates_by_chars, p9_found, p9_scores, p9_links_and_tags)
}

_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_P7 = f"""d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT item_id, {_WORDS} AS w FROM eval_items WHERE text IS NOT NULL),
dr AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS r FROM d, unnest(range(1, len(w) - 11)) AS t(i)),
er AS (SELECT item_id, i AS j, array_to_string(w[i:i + 12], ' ') AS r FROM e, unnest(range(1, len(w) - 11)) AS t(i))"""
_P3 = r"""t AS (SELECT email_id, list_filter(regexp_split_to_array(lower(coalesce(subject, '') || ' ' || coalesce(body, '')), '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda x: x <> '') AS w FROM parse_eml),
s AS (SELECT DISTINCT email_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) AS u(i) WHERE len(w) >= 40),
n AS (SELECT email_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.email_id AS x, b.email_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.email_id < b.email_id GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    # a document and an item that share 13 words in a row share a run of 13 words
    "p7_found": f"WITH {_P7} SELECT DISTINCT doc_id, item_id FROM dr JOIN er USING (r)",
    # runs of 13 that follow each other in both texts make one longer match
    "p7_leaks": f"""WITH {_P7}, h AS (SELECT DISTINCT doc_id, item_id, i, j FROM dr JOIN er USING (r)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS k FROM h),
m AS (SELECT doc_id, item_id, count(*) + 12 AS words, min(i) - 1 AS doc_pos, min(j) - 1 AS item_pos FROM g GROUP BY doc_id, item_id, i - j, k)
SELECT doc_id, item_id, CAST(words AS INT) AS words, CAST(doc_pos AS INT) AS doc_pos, CAST(item_pos AS INT) AS item_pos FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_pos, item_pos) = 1""",
    "p7_clean": f"WITH {_P7} SELECT * REPLACE (epoch_us(received_at) AS received_at) FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM dr JOIN er USING (r))",
    "p3_found": f"WITH {_P3} SELECT x AS email_id_a, y AS email_id_b FROM o JOIN n a ON a.email_id = x JOIN n b ON b.email_id = y WHERE c >= 0.6 * (a.n + b.n - c)",
    # messages with the same words in the same order are one class; links lead to other classes
    "p3_link_counts": f"""WITH {_P3}, k AS (SELECT email_id, array_to_string(w, ' ') AS txt FROM t WHERE len(w) >= 40), q AS (SELECT *, min(email_id) OVER (PARTITION BY txt) AS class_id, count(*) OVER (PARTITION BY txt) AS copies FROM k),
l AS (SELECT DISTINCT p.class_id AS u, r.class_id AS v FROM o JOIN n a ON a.email_id = x JOIN n b ON b.email_id = y JOIN q p ON p.email_id = x JOIN q r ON r.email_id = y WHERE c >= 0.6 * (a.n + b.n - c) AND p.class_id <> r.class_id),
z AS (SELECT u, count(*) AS links FROM (SELECT u, v FROM l UNION SELECT v, u FROM l) GROUP BY 1)
SELECT email_id, class_id, copies, coalesce(links, 0) AS links FROM q LEFT JOIN z ON u = class_id""",
    "p8_rates_by_chars": """WITH t AS (SELECT source, sum(target_share) AS share, min(max_repeats) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY 1), o AS (SELECT source, count(*) AS n_docs, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY 1),
j AS (SELECT t.source, share, most, coalesce(n_docs, 0) AS n_docs, coalesce(size, 0) AS size FROM t LEFT JOIN o ON o.source = t.source), w AS (SELECT *, CAST(sum(size) OVER () AS BIGINT) AS total FROM j)
SELECT source, n_docs, size, total, round(CASE WHEN size > 0 THEN greatest(0, least(share * total / size, most)) ELSE 0 END, 9) AS rate FROM w""",
    "p9_links_and_tags": r"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INT) AS words, round(len(list_filter(w, lambda t: regexp_matches(t, 'https?://|www\.|href=|\]\(|</?a\b'))) / greatest(len(w), 1), 9) AS link_share, round(len(list_filter(w, lambda t: regexp_matches(t, '#\pL[\pL\pN_]*$'))) / greatest(len(w), 1), 9) AS tag_share FROM x""",
}
