"""Platform tables as views over the given tables, in Spark SQL and in DuckDB SQL.

{A} and {Z} open and close an array literal, {D} marks a double literal's suffix.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "users": """SELECT CAST(c_custkey AS BIGINT) AS user_id, c_name AS full_name, lower(concat(c_name,'@x.test')) AS email,
  c_custkey % 5 = 0 AS is_instructor, c_custkey % 97 = 0 AS is_admin, c_acctbal < 0 AS is_banned,
  c_mktsegment AS interest FROM customer""",
    "plans": """SELECT CAST(p_partkey AS BIGINT) AS plan_id, p_name AS title, CAST(p_partkey % 150 AS BIGINT) AS owner_id,
  CASE WHEN p_partkey % 3 = 0 THEN CAST((p_partkey * 7) % 150 AS BIGINT) END AS instructor_id,
  CASE p_type WHEN 'ECONOMY' THEN 'Easy' WHEN 'SMALL' THEN 'basic' WHEN 'MEDIUM' THEN 'Medium'
    WHEN 'STANDARD' THEN 'intermediate' WHEN 'PROMO' THEN 'Hard' ELSE 'Advanced' END AS level,
  p_brand AS category, split(p_name, ' ') AS tags, p_size % 2 = 0 AS is_public, p_size % 10 = 9 AS is_deleted,
  1 + p_size % 14 AS duration,
  CASE WHEN p_partkey % 7 = 0 AND p_partkey > 0 THEN CAST(p_partkey - 1 AS BIGINT) END AS original_plan_id,
  p_retailprice AS created_rank FROM part""",
    "enrollments": """SELECT o_orderkey AS enrollment_id, o_custkey AS learner_id, o_orderkey % 200 AS plan_id,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'completed' ELSE 'pending' END AS status,
  o_orderdate AS created_at FROM orders""",
    "reviews": """SELECT l_orderkey * 10 + l_linenumber AS review_id, root_plan AS plan_id, sk AS user_id,
  CASE WHEN l_linenumber = ml THEN CAST(1 + CAST(q AS BIGINT) % 5 AS INT) END AS rating,
  CASE WHEN l_linenumber > ml THEN l_orderkey * 10 + ml END AS parent_id,
  rf = 'R' AS is_deleted, sd AS created_at FROM (
    SELECT d.*, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS ml, min(pk) OVER (PARTITION BY l_orderkey) AS root_plan FROM (
      SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk, min(l_quantity) AS q,
        min(l_returnflag) AS rf, min(l_shipdate) AS sd FROM lineitem GROUP BY l_orderkey, l_linenumber) d) m""",
    "submissions": """SELECT event_id AS submission_id, user_id, event_id % 10 AS plan_id, event_type AS topic, event_id % 7 + 1 AS day_number,
  CAST(floor(least(100.0{D}, value) + 0.5{D}) AS INT) AS pct, ts FROM events""",
    "lessons": """SELECT doc_id AS lesson_id, CAST(floor(doc_id / 7) AS BIGINT) AS plan_id, doc_id % 7 + 1 AS day_number,
  substring(text, 1, 40) AS title, text AS content FROM documents""",
    "chunks": """SELECT e.vec_id AS chunk_id, CAST(e.label AS BIGINT) AS plan_id, e.vec_id AS chunk_index, d.text AS content,
  d.source AS section, e.embedding AS embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
    "search_chunks": """SELECT e.vec_id AS chunk_id, CAST(e.label AS BIGINT) AS plan_id, e.vec_id AS chunk_index,
  CASE WHEN e.vec_id % 9 = 0 THEN concat('A shared passage of part ', CAST(e.label AS STRING), '.') WHEN e.vec_id % 31 = 0 THEN ''
    WHEN e.vec_id % 4 > 0 THEN concat(d.text, d.text, d.text, d.text, d.text, d.text, d.text, d.text) ELSE d.text END AS content,
  CASE WHEN e.vec_id % 6 = 0 THEN CAST(NULL AS STRING) WHEN e.vec_id % 6 = 1 THEN concat('1.', CAST(e.label AS STRING), ' Part One: the ', d.source, ' (a) of *many* parts')
    WHEN e.vec_id % 6 = 2 THEN 'Quoted' ELSE d.source END AS section,
  CASE WHEN e.vec_id % 5 = 0 THEN 'trigger' WHEN e.vec_id % 5 = 1 THEN 'cursor' WHEN e.vec_id % 5 = 2 THEN 'natural_science' END AS topic,
  CASE WHEN e.label <> 3 AND e.vec_id % 5 <> 1 AND e.vec_id % 6 <> 2 THEN e.embedding END AS embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id""",
    "chat_questions": """SELECT b.item_id AS query_id, CAST(CASE WHEN b.item_id % 13 = 0 THEN 3 ELSE e.label END AS BIGINT) AS plan_id,
  CASE WHEN b.item_id % 3 = 0 THEN concat('kích hoạt ', b.text) WHEN b.item_id % 3 = 1 THEN 'con trỏ?' WHEN b.item_id % 6 = 2 THEN 'giao dịch' ELSE '???' END AS text,
  CASE WHEN b.item_id % 11 <> 0 THEN e.embedding END AS vector,
  CASE WHEN b.item_id % 8 = 0 THEN {A}concat('##   1.', CAST(e.label AS STRING), '   Part One: the src1 and more words that go on'), 'x', ' '{Z}
    WHEN b.item_id % 8 = 1 THEN {A}'no such section'{Z} WHEN b.item_id % 8 = 2 THEN {A}'# SRC1', 'src1'{Z} WHEN b.item_id % 8 = 3 THEN {A}'quoted'{Z}
    WHEN b.item_id % 8 = 4 THEN {A}'(a) of *many* parts, a name of 33 c. and on it goes', 'src2'{Z}
    WHEN b.item_id % 8 = 5 THEN {A}'(A) of *many*', 'src3'{Z} END AS sections
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "questions": """SELECT CAST(p_partkey AS BIGINT) AS question_id, CAST(p_partkey % 50 AS BIGINT) AS lesson_id,
  concat('Which label fits item ', CAST(p_partkey AS STRING), CASE WHEN p_size % 3 = 0 THEN '' ELSE '?' END) AS question,
  {A}concat('A. ', p_name, ' item'), concat(p_brand, ' item'), concat(p_type, ' item'),
    CASE WHEN p_size % 6 = 0 THEN concat(p_brand, ' item') ELSE concat('size ', CAST(p_size AS STRING)) END{Z} AS options,
  p_size % 5 AS correct_answer,
  CASE p_size % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN p_size % 4 = 0 THEN 'short' ELSE concat('Because the catalogue lists it as ', p_type) END AS explanation FROM part""",
    "attempts": """SELECT event_id AS attempt_id, user_id, event_id % 20 AS quiz_id, ts,
  {A}event_id % 4, CAST(floor(event_id / 4) AS BIGINT) % 4, CAST(floor(event_id / 16) AS BIGINT) % 4{Z} AS answers FROM events""",
    "friendships": """SELECT o_orderkey AS friendship_id, o_custkey AS requester, (o_orderkey * 31) % 150 AS recipient,
  CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'F' THEN 'pending' ELSE 'rejected' END AS status, o_orderdate AS updated_at
  FROM orders WHERE o_custkey <> (o_orderkey * 31) % 150""",
}

MARKED_SPARK = r"""SELECT doc_id, array_join(transform(split(text,'\n'),(l,i)->CASE
  WHEN i % 6 = 0 THEN concat('## ',CAST(CAST(floor(i/6) AS INT)+1 AS STRING),'.1 ',substring(l,1,30),'\n',l)
  WHEN i % 6 = 3 THEN concat('\n',l) ELSE l END),'\n') AS text FROM documents"""
MARKED_DUCK = """SELECT doc_id, array_to_string(list_transform(string_split(text,chr(10)),lambda l,i: CASE
  WHEN (i-1) % 6 = 0 THEN concat('## ',CAST(CAST(floor((i-1)/6) AS INT)+1 AS VARCHAR),'.1 ',substring(l,1,30),chr(10),l)
  WHEN (i-1) % 6 = 3 THEN concat(chr(10),l) ELSE l END),chr(10)) AS text FROM documents"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def spark_sql(name: str) -> str:
    return MARKED_SPARK if name == "marked_documents" else VIEWS[name].format(A="array(", Z=")", D="D")


def duck_sql(name: str) -> str:
    return MARKED_DUCK if name == "marked_documents" else VIEWS[name].format(A="[", Z="]", D="::DOUBLE")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = spark_sql(name)
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql.replace("{A}", "array(").replace("{Z}", ")"), **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    names = [n for n in [*VIEWS, "marked_documents"] if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} AS ({duck_sql(n)})" for n in names)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head}\n{body}"
