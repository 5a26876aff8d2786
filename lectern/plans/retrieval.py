"""Classification, search and retrieval queries, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sql import register
from ..functions.text import RERANK_STOP, REUSE_STOP, embedding_input
from ..operators import classify as N
from ..operators import retrieval as V
from .registry import query
from .text import marks


def rule_sql(column: str) -> str:
    """topic of a column by the same rules in DuckDB."""
    q = lambda p: p.replace("'", "''")
    counts = ", ".join(
        "{'n': " + " + ".join(f"len(regexp_extract_all({column}, '(?i){q(p)}'))" for p in ps) + f", 'k': {-k}, 'topic': '{t}'}}" for k, (t, ps) in enumerate(N.TOPICS)
    )
    return f"(SELECT CASE WHEN m.n > 0 THEN m.topic ELSE 'general' END FROM (SELECT list_max([{counts}]) AS m))"


TOPIC_SQL = f"SELECT chunk_id, plan_id, {rule_sql('x')} AS topic FROM (SELECT chunk_id, plan_id, concat(section, chr(10), content) AS x FROM chunks)"
query("n1_classify_topics", f"SELECT chunk_id, topic FROM ({TOPIC_SQL})")(lambda t: N.classify_topics(t.chunks).select("chunk_id", "topic"))
query("g8_topic_distribution", f"SELECT topic, count(*) AS n FROM ({TOPIC_SQL}) GROUP BY topic")(lambda t: N.classify_topics(t.chunks).groupBy("topic").agg(F.count("*").alias("n")))
query("s13_backfill_topics", f"SELECT c.chunk_id, CASE WHEN c.chunk_id % 2 = 0 THEN 'kept' ELSE s.topic END AS topic FROM chunks c JOIN ({TOPIC_SQL}) s ON s.chunk_id = c.chunk_id")(
    lambda t: N.backfill_topics(t.chunks.withColumn("topic", F.when(F.col("chunk_id") % 2 == 0, "kept").otherwise("general"))).select("chunk_id", "topic")
)


def rules_any(column: str) -> str:
    q = lambda p: p.replace("'", "''")
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({column}, '(?i){q('|'.join(f'(?:{p})' for p in ps))}') THEN '{t}' END" for t, ps in N.TOPICS) + "], lambda x: x IS NOT NULL)"


HINT_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{t}' END" for t, p in N.HINTS) + "], lambda x: x IS NOT NULL)"
query("n6_infer_topics", f"SELECT doc_id, array_to_string(CASE WHEN len({rules_any('text')}) > 0 THEN {rules_any('text')} ELSE {HINT_SQL} END, ',') AS topics FROM documents")(
    lambda t: N.infer_topics(t.documents.select("doc_id", "text")).select("doc_id", F.array_join("topics", ",").alias("topics"))
)

Q = "SELECT chunk_id AS query_id, plan_id, embedding AS vector FROM chunks WHERE chunk_id % 50 = 0"
COS = "round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)"


def queries(t):
    return t.chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "plan_id", F.col("embedding").alias("vector"))


query("v2_cosine", f"SELECT q.query_id, c.chunk_id, round(list_cosine_similarity(CAST(q.vector AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 4) AS score FROM ({Q}) q JOIN chunks c ON c.plan_id = q.plan_id")(
    lambda t: queries(t).join(t.chunks, "plan_id").select("query_id", "chunk_id", F.round(V.cosine("vector", "embedding"), 4).alias("score"))
)


def search_sql(asked: str, k: int, name: str = "r") -> str:
    """Named queries that end in one with the rows of a search (query_id, chunk_id, content, section, topic, score, rank, path); asked has query_id, plan_id, vector, topics."""
    return f"""{name}q AS ({asked}),
{name}0 AS (SELECT query_id, chunk_id, content, score, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS near FROM (SELECT q.query_id, topics, c.chunk_id, c.content, c.topic, {COS} AS score
    FROM {name}q q JOIN search_chunks c ON c.plan_id = q.plan_id WHERE vector IS NOT NULL AND embedding IS NOT NULL))
  WHERE near <= CASE WHEN len(topics) > 0 THEN {6 * k} ELSE {2 * k} END AND (len(topics) = 0 OR list_contains(topics, topic)))) WHERE n <= {2 * k}),
{name}1 AS (SELECT query_id, chunk_id, content, NULL::DOUBLE AS score, n FROM (SELECT q.query_id, c.chunk_id, c.content, row_number() OVER (PARTITION BY q.query_id ORDER BY chunk_index) AS n
  FROM {name}q q JOIN search_chunks c ON c.plan_id = q.plan_id AND list_contains(topics, topic) WHERE q.query_id NOT IN (SELECT query_id FROM {name}0)) WHERE n <= {2 * k}),
{name}2 AS (SELECT query_id, chunk_id, content, NULL::DOUBLE AS score, n FROM (SELECT q.query_id, c.chunk_id, c.content, row_number() OVER (PARTITION BY q.query_id ORDER BY chunk_index) AS n
  FROM {name}q q JOIN search_chunks c ON c.plan_id = q.plan_id WHERE q.query_id NOT IN (SELECT query_id FROM {name}0 UNION ALL SELECT query_id FROM {name}1)) WHERE n <= {2 * k}),
{name}u AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY n) AS copy FROM (
  SELECT *, 'vector' AS path FROM {name}0 UNION ALL SELECT *, 'first of topic' FROM {name}1 UNION ALL SELECT *, 'first of plan' FROM {name}2) WHERE content <> ''),
{name} AS (SELECT query_id, u.chunk_id, substring(u.content, 1, 2000) AS content, coalesce(section, '') AS section, coalesce(topic, 'general') AS topic, CASE WHEN score <> 0 THEN score ELSE 0.5::DOUBLE END AS score, rank, path FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS rank FROM {name}u WHERE copy = 1) u JOIN search_chunks c ON c.chunk_id = u.chunk_id WHERE rank <= {k})"""


def section_sql(asked: str, k: int) -> str:
    """The same for a search by sections; asked has sections as well."""
    return rf"""aq AS ({asked}),
nm AS (SELECT query_id, trim(regexp_replace(regexp_replace(trim(s), '^#{{1,6}}\s+', ''), '\s+', ' ', 'g')) AS s FROM (SELECT query_id, unnest(sections) AS s FROM aq)),
fr AS (SELECT query_id, trim(substring(s, 1, 40)) AS f FROM nm UNION ALL SELECT query_id, trim(substring(concat(regexp_extract(s, '^(\d+(\.\d+)+) (.+)', 1), ' ', array_to_string(string_split(regexp_extract(s, '^(\d+(\.\d+)+) (.+)', 3), ' ')[1:4], ' ')), 1, 40))
  FROM nm WHERE regexp_matches(s, '^\d+(\.\d+)+ ..')),
es AS (SELECT query_id, substring(regexp_replace(f, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), 1, 40) AS e FROM fr WHERE length(f) >= 2),
br AS (SELECT query_id FROM es WHERE length(regexp_extract(e, '(\\*)$', 1)) % 2 = 1),
sc AS (SELECT DISTINCT aq.query_id, aq.vector, c.* FROM aq JOIN (SELECT * FROM es WHERE query_id NOT IN (SELECT query_id FROM br)) e ON e.query_id = aq.query_id JOIN search_chunks c ON c.plan_id = aq.plan_id
  WHERE vector IS NOT NULL AND regexp_matches(section, CASE WHEN length(regexp_extract(e, '(\\*)$', 1)) % 2 = 1 THEN 'x' ELSE e END, 'i')),
sh AS (SELECT query_id, chunk_id, substring(content, 1, 2000) AS content, section, coalesce(topic, 'general') AS topic, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, 'section' AS path FROM (
  SELECT query_id, chunk_id, content, section, topic, {COS.replace('q.vector', 'vector').replace('c.embedding', 'embedding')} AS score FROM sc WHERE embedding IS NOT NULL)),
{search_sql("SELECT query_id, plan_id, vector, topics FROM aq WHERE query_id NOT IN (SELECT query_id FROM sc)", k)},
found AS (SELECT * FROM sh WHERE rank <= {k} UNION ALL SELECT * FROM r)"""


TOPICLESS = "CAST([] AS VARCHAR[]) AS topics"
SHOWN = "query_id, chunk_id, CAST(rank AS INT) AS rank, score, path, section, topic, md5(content) AS digest"
SQ = "SELECT chunk_id AS query_id, plan_id, CASE WHEN chunk_id % 250 <> 0 THEN embedding END AS vector FROM chunks WHERE chunk_id % 50 = 0"


def searched(t):
    return t.chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "plan_id", F.when(F.col("chunk_id") % 250 != 0, F.col("embedding")).alias("vector"))


def shown(hits):
    return hits.select("query_id", "chunk_id", "rank", "score", "path", "section", "topic", F.md5("content").alias("digest"))


query("v3_vector_search", f"WITH {search_sql(f'SELECT *, {TOPICLESS} FROM ({SQ})', 6)} SELECT {SHOWN} FROM r")(lambda t: shown(V.vector_search(searched(t), t.search_chunks, 6)))
BY_TOPIC = "CASE WHEN query_id % 200 = 0 THEN ['trigger', 'natural_science'] WHEN query_id % 200 = 50 THEN ['cursor'] WHEN query_id % 200 = 100 THEN ['no such topic'] ELSE [] END AS topics"
query("v4_vector_search_by_topic", f"WITH {search_sql(f'SELECT *, {BY_TOPIC} FROM ({SQ})', 4)} SELECT {SHOWN} FROM r")(
    lambda t: shown(V.vector_search_by_topic(searched(t).withColumn("topics", F.expr(BY_TOPIC.replace("[]", "array()").replace("[", "array(").replace("]", ")"))), t.search_chunks, 4))
)
#: Queries of which half have no vector, and a plan without any embedding.
NONE = "SELECT query_id, CASE WHEN query_id % 100 = 0 THEN 3 ELSE plan_id END AS plan_id, CASE WHEN query_id % 3 > 0 THEN vector END AS vector"
query("v5_first_chunks", f"WITH {search_sql(f'{NONE}, {TOPICLESS} FROM ({SQ})', 3)} SELECT {SHOWN} FROM r WHERE path <> 'vector'")(
    lambda t: shown(V.vector_search(searched(t).selectExpr("query_id", "CASE WHEN query_id % 100 = 0 THEN 3 ELSE plan_id END AS plan_id", "CASE WHEN query_id % 3 > 0 THEN vector END AS vector"), t.search_chunks, 3).where("path <> 'vector'"))
)
query("v6_search_by_section", f"WITH {section_sql(f'SELECT query_id, plan_id, vector, sections, {TOPICLESS} FROM chat_questions', 5)} SELECT {SHOWN} FROM found")(lambda t: shown(V.search_by_section(t.chat_questions, t.search_chunks, 5)))

STOP = ", ".join(f"'{w}'" for w in RERANK_STOP)
INFERRED = f"CASE WHEN len({rules_any('text')}) > 0 THEN {rules_any('text')} ELSE {HINT_SQL} END"
ROUTED = section_sql(f"SELECT query_id, plan_id, vector, sections, CASE WHEN len(sections) > 0 THEN [] ELSE {INFERRED} END AS topics FROM chat_questions", 12)
RERANK = rf"""kw AS (SELECT query_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^A-Za-z0-9_\s\x{{00C0}}-\x{{024F}}]', ' ', 'g'), '\s+'), lambda x: length(x) >= 4 AND x NOT IN ({STOP})) AS kw FROM chat_questions),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, chunk_id) AS place FROM (SELECT f.*, round(0.7::DOUBLE * score + 0.3::DOUBLE * CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda x: contains(lower(content), x))) / len(kw) ELSE 0.0 END, 9) AS final FROM found f JOIN kw ON kw.query_id = f.query_id)),
ct AS (SELECT *, sum(length(concat('[', CASE WHEN section = '' THEN 'Tài liệu' ELSE section END, ']', chr(10), content, chr(10), chr(10)))) OVER (PARTITION BY query_id ORDER BY place) <= 12000 AS in_budget FROM rr WHERE place <= 6)"""
query("o6_rerank_keywords", f"WITH {ROUTED}, {RERANK} SELECT query_id, chunk_id, final, CAST(place AS INT) AS rank FROM rr WHERE place <= 6")(
    lambda t: V.retrieve_context(t.chat_questions, t.search_chunks).select("query_id", "chunk_id", "final", "rank")
)
query("v7_retrieve_context", f"WITH {ROUTED}, {RERANK} SELECT query_id, chunk_id, CAST(place AS INT) AS rank, final, section, substring(content, 1, 120) AS preview, path, in_budget FROM ct")(
    lambda t: V.retrieve_context(t.chat_questions, t.search_chunks).drop("content")
)
query(
    "w9_context_of_prompts",
    f"WITH {ROUTED}, {RERANK} SELECT query_id, md5(string_agg(concat('[', CASE WHEN section = '' THEN 'Tài liệu' ELSE section END, ']', chr(10), content, chr(10), chr(10)), '' ORDER BY place)) AS digest FROM ct WHERE in_budget GROUP BY query_id",
)(lambda t: V.context_of(V.retrieve_context(t.chat_questions, t.search_chunks)).select("query_id", F.md5("context").alias("digest")))
query("v9_index_lessons", r"SELECT lesson_id, substring(trim(regexp_replace(concat(title, '. ', content), '\s+', ' ', 'g')), 1, 400) AS topic_text FROM lessons WHERE trim(content) <> ''")(
    lambda t: t.lessons.where("trim(content) <> ''").select("lesson_id", embedding_input(F.concat("title", F.lit(". "), "content"), 400).alias("topic_text"))
)
IDX = "SELECT chunk_id AS lesson_id, chunk_id % 40 AS plan_id, chunk_id % 9 AS owner_id, content AS topic, embedding AS vector, chunk_id % 2 = 0 AS is_public FROM chunks"


def index(t):
    return t.chunks.selectExpr("chunk_id AS lesson_id", "chunk_id % 40 AS plan_id", "chunk_id % 9 AS owner_id", "content AS topic", "embedding AS vector", "chunk_id % 2 = 0 AS is_public")


REUSE = ", ".join(f"'{w}'" for w in REUSE_STOP)
KW = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(translate({marks('topic')}, 'đ', 'd'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) >= 3 AND x NOT IN ({REUSE})))"


def reuse_sql(own: float, public: float, overlap: float, idx: str = IDX) -> str:
    return f"""WITH i AS (SELECT *, {KW} AS kw FROM ({idx})), s AS (SELECT r.lesson_id, r.plan_id AS rp, r.owner_id AS ro, r.kw AS rk, i.lesson_id AS source_id, i.plan_id AS ip, i.owner_id AS io, i.kw AS ik, i.is_public, round(list_cosine_similarity(CAST(r.vector AS DOUBLE[]), CAST(i.vector AS DOUBLE[])), 6) AS score FROM i r JOIN i ON r.lesson_id <> i.lesson_id WHERE r.lesson_id % 50 = 0),
b AS (SELECT *, true AS own FROM s WHERE ro = io AND score >= {own} UNION ALL SELECT *, false FROM s WHERE is_public AND score >= {public}),
n AS (SELECT *, row_number() OVER (PARTITION BY lesson_id, own ORDER BY score DESC, source_id) AS n FROM b),
p AS (SELECT * FROM n WHERE n <= 20 AND rp <> ip AND (own OR ro <> io) AND CASE WHEN len(rk) = 0 OR len(ik) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(rk, ik)) / (len(rk) + len(ik) - len(list_intersect(rk, ik))) END >= {overlap})
SELECT lesson_id, source_id, score, own FROM (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY own DESC, score DESC, source_id) AS m FROM p) WHERE m = 1"""


query("v10_reuse_candidates", reuse_sql(0.88, 0.92, 0.15))(lambda t: V.reuse_candidates(index(t).where("lesson_id % 50 = 0").drop("is_public"), index(t)))
#: The fixture's vectors are hardly alike, so the same rules are also run at thresholds that some of them reach.
query("v10_reuse_low_thresholds", reuse_sql(0.3, 0.35, 0.01))(lambda t: V.reuse_candidates(index(t).where("lesson_id % 50 = 0").drop("is_public"), index(t), own=0.3, public=0.35, overlap=0.01))
#: Every lesson also as a near copy: of another plan, half of them of another owner, with an eighth of the vector's components gone.
ALIKE = f"{IDX} UNION ALL SELECT chunk_id + 100000, chunk_id % 40 + 1, (chunk_id + chunk_id % 3) % 9, content, list_transform(embedding, lambda x, i: CASE WHEN i % 8 = 1 THEN 0 ELSE x END), chunk_id % 4 < 3 FROM chunks"


def alike(t):
    near = t.chunks.select((F.col("chunk_id") + 100_000).alias("lesson_id"), (F.col("chunk_id") % 40 + 1).alias("plan_id"), ((F.col("chunk_id") + F.col("chunk_id") % 3) % 9).alias("owner_id"), F.col("content").alias("topic"), F.transform("embedding", lambda x, i: F.when(i % 8 == 0, 0.0).otherwise(x).cast("float")).alias("vector"), (F.col("chunk_id") % 4 < 3).alias("is_public"))
    return index(t).unionByName(near)


query("v10_reuse_near_copies", reuse_sql(0.88, 0.92, 0.15, ALIKE))(lambda t: V.reuse_candidates(alike(t).where("lesson_id % 50 = 0").drop("is_public"), alike(t)))
query("v1_vectorize")(lambda t: V.vectorize(t.documents, "doc_id", "text"))
query("v13_ann_search")(lambda t: V.ann_search(searched(t), t.search_chunks, 6).select("query_id", "chunk_id", "rank"))
query("v13_retrieve_context")(lambda t: (lambda x: V.retrieve_context(t.chat_questions, t.search_chunks, near_by=V.candidates(t.chat_questions, V.file_chunks(t.search_chunks, x), x, 72)).drop("content"))(V.fit_index(t.search_chunks)))
query("v12_sync_public", "SELECT i.lesson_id, coalesce(p.is_public, i.lesson_id % 2 = 0) AS is_public FROM lessons i LEFT JOIN plans p ON p.plan_id = i.plan_id")(
    lambda t: V.sync_public(t.lessons.select("lesson_id", "plan_id", (F.col("lesson_id") % 2 == 0).alias("is_public")), t.plans).select("lesson_id", "is_public")
)
query("s14_lessons_to_index", "SELECT l.lesson_id, l.plan_id, owner_id, is_public FROM lessons l JOIN plans p ON p.plan_id = l.plan_id WHERE l.lesson_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")(
    lambda t: V.lessons_to_index(t.lessons, t.plans, t.embeddings.where("vec_id % 2 = 0").select(F.col("vec_id").alias("lesson_id")))
)


@query(
    "sql_functions",
    """SELECT c.chunk_id, round(list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 4) AS score,
  round(len(list_intersect(string_split(c.content, ' '), string_split(d.content, ' '))) / len(list_distinct(list_concat(string_split(c.content, ' '), string_split(d.content, ' ')))), 6) AS overlap,
  (['remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'])[CAST(least(5, floor((c.chunk_id % 9) / greatest(1, 8) * 6)) AS INT) + 1] AS bloom,
  CAST(CASE c.chunk_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS INT) AS level
FROM chunks c JOIN chunks d ON d.chunk_id = c.chunk_id + 1""",
)
def sql_functions(t):
    """SQL text over the platform's tables that calls the functions."""
    register(t.spark)
    return t.spark.sql(
        """SELECT c.chunk_id, round(cosine(c.embedding, d.embedding), 4) AS score, round(jaccard(split(c.content, ' '), split(d.content, ' ')), 6) AS overlap,
  bloom_level(CAST(c.chunk_id % 9 AS INT) + 1, 9) AS bloom, heading_level(element_at(array('2.1 Parts', 'Chapter 4', 'TWO WORDS', 'a line'), CAST(c.chunk_id % 4 AS INT) + 1)) AS level
FROM {chunks} c JOIN {chunks} d ON d.chunk_id = c.chunk_id + 1""",
        chunks=t.chunks,
    )


def counted_letters(texts: list[str]) -> list[list[float]]:
    """A model for the hook: how often a text has each letter."""
    return [[float(x.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for x in texts]


LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: length(text) - length(replace(lower(text), c, '')))"
query("v1_model_vectors", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1.0,2.0' ELSE array_to_string(list_transform({LETTERS}, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') END AS vector FROM documents")(
    lambda t: V.vectorize(t.documents.withColumn("own", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0)))), "doc_id", "text", model=counted_letters, given="own").select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ",").alias("vector"))
)
