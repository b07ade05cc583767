"""The pN_ queries of the text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import garbled, leaks, lookalikes, spans, tokenize
from blockloom.session import read_table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repair_names(read_table(spark, d, "dirent", "entry_id", "name")).select("entry_id").distinct()


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.repair_names(read_table(spark, d, "dirent", "entry_id", "name"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(read_table(spark, d, "dirent", "entry_id", "image_id", "dir_inode", "name"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per entry that looks like another one of its directory."""
    return lookalikes.look_classes(read_table(spark, d, "dirent", "entry_id", "image_id", "dir_inode", "name"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(read_table(spark, d, "documents", "doc_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text", "line_boxes")
    return leaks.find_leaks(docs, read_table(spark, d, "eval_item", "item_id", "text")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(read_table(spark, d, "documents", "doc_id", "text"))


def p8_share(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents", "doc_id", "text")
    return spans.shared_share(docs, p8_found(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_restored, p4_found, p4_classes, p6_ids, p7_found, p8_found, p8_share)}

_P8 = """
WITH w AS (
  SELECT doc_id, s, md5(substr(text, s + 1, 320)) AS h FROM (SELECT DISTINCT doc_id, text, unnest(range(0, length(text) - 319)) AS s FROM documents WHERE length(text) >= 320)),
dup AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN dup USING (h)),
isl AS (SELECT *, sum(CASE WHEN s - prev <= 320 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
  FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS prev FROM hit)),
found AS (SELECT doc_id, min(s) AS span_start, max(s) + 320 AS span_end FROM isl GROUP BY doc_id, g)
"""

SQL = {
    "p8_found": _P8 + "SELECT doc_id, span_start, span_end FROM found",
    "p8_share": _P8
    + """SELECT d.doc_id, coalesce(CAST(sum(f.span_end - f.span_start) AS BIGINT), 0) AS n_shared, coalesce(max(length(d.text)), 0) AS n_chars
FROM (SELECT DISTINCT doc_id, text FROM documents) d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id""",
}
