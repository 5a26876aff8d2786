"""Vector search inside plans, re-ranking, budgets and reuse candidates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, rerank_keywords, reuse_keywords
from ..sources.files import small_batches
from .classify import infer_topics
from .vectors import QuantisedIndex, candidates, file_chunks, fit_index, nearest_pairs


#: Characters of a chunk that a search returns, and its score where there is none.
CONTENT_CHARS, DEFAULT_SCORE = 2000, 0.5
#: The section of a context line where the chunk has none.
NO_SECTION = "Tài liệu"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two arrays in double precision, 0 where their lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(F.size(a) == F.size(b), _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)) + 1e-9)).otherwise(0.0)


def with_length(df: DataFrame, vector: str) -> DataFrame:
    """The vector's length as a column, so that pairs need one product only."""
    return df.withColumn(f"{vector}_length", F.sqrt(_dot(F.col(vector), F.col(vector))))


def pair_cosine(a: str, b: str) -> Column:
    """cosine of two columns that with_length has measured, to six places."""
    whole = _dot(F.col(a), F.col(b)) / (F.col(f"{a}_length") * F.col(f"{b}_length") + 1e-9)
    return F.round(F.when(F.size(a) == F.size(b), whole).otherwise(0.0), 6)


def _scored(queries: DataFrame, chunks: DataFrame, on: list[str], *keep: str) -> DataFrame:
    """query_id, chunk_id, score and the columns of keep for the pairs that meet."""
    pairs = with_length(queries, "vector").join(with_length(chunks, "embedding"), on)
    return pairs.select("query_id", "chunk_id", *keep, pair_cosine("vector", "embedding").alias("score"))


def _best(hits: DataFrame, by: list[str], n: int | Column, name: str, *order: Column | str) -> DataFrame:
    return hits.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def _bare(chunks: DataFrame) -> DataFrame:
    """Chunks for ranking: a digest stands for the content, so that texts are moved for the chosen ones only."""
    has = lambda c: F.col(c) if c in chunks.columns else F.lit(None)
    return chunks.select("chunk_id", "plan_id", "chunk_index", has("topic").cast("string").alias("topic"), "embedding", F.when(F.col("content") != "", F.md5("content")).alias("_text"))


def _shown(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chosen hits with chunk_index, content cut to size, section, topic and score, where they lack one with the default."""
    has = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other)) if c in chunks.columns else F.lit(other)
    texts = chunks.select("chunk_id", "chunk_index", F.substring("content", 1, CONTENT_CHARS).alias("content"), has("section", "").alias("section"), has("topic", "general").alias("topic"))
    return hits.join(texts, "chunk_id")


def _first_chunks(queries: DataFrame, bare: DataFrame, k: int, stage: int, by: list[str]) -> DataFrame:
    """The first 2k chunks of each query's plan (and topics): the first of every plan are taken once, for all of its queries."""
    heads = _best(bare.drop("embedding"), by, 2 * k, "n", "chunk_index", "chunk_id")
    rows = queries.join(heads, by).select("query_id", "chunk_id", "chunk_index", "_text").distinct()
    rows = _best(rows, ["query_id"], 2 * k, "n", "chunk_index", "chunk_id")
    return rows.select("query_id", "chunk_id", "_text", F.lit(None).cast("double").alias("score"), "n", F.lit(stage).alias("stage"))


def _kind(vector: str) -> Column:
    """0: a vector with a direction; 1: all zeros; 2: a null inside; 3: not all finite; 4: squares that leave the range of doubles."""
    long, x = F.sqrt(_dot(F.col(vector), F.col(vector))), lambda test: F.exists(vector, lambda v: test(v.cast("double")))
    infinite = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(long.isNull(), 2).when((long > 0) & (long < float("inf")), 0).when(~x(lambda v: v != 0), 1).when(x(infinite), 3).otherwise(4)


def _nearest(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(query_id, chunk_id): pairs of a plan among which are each query's n best by score and chunk_id. queries: query_id, plan_id,
    vector; chunks: chunk_id, plan_id, embedding, none of them empty. Products of blocks of vectors choose them, n of those that are equal at most; of chunks
    whose score is one and the same whatever the direction (of another length, zero, not all numbers) each plan's first n are taken."""
    asked, had = (dict(d.dtypes)[c] for d, c in ((queries, "query_id"), (chunks, "chunk_id")))
    common = had if asked == had else "string"
    q = queries.select(F.col("query_id").cast(common).alias("key"), F.col("plan_id").alias("part"), "vector", _kind("vector").alias("kind"), F.size("vector").alias("long"))
    c = chunks.select("chunk_id", F.col("plan_id").alias("i_part"), "embedding", _kind("embedding").alias("i_kind"), F.size("embedding").alias("i_long"))
    some = _best(c.where("i_kind = 0"), ["i_part", "embedding"], n, "copy", "chunk_id")
    found = nearest_pairs(
        q.where("kind = 0").select("key", "vector", "part"),
        some.select(F.col("chunk_id").cast(common).alias("i_key"), F.col("embedding").alias("i_vector"), "i_part"), -2.0, n, itself=True,
    )
    bare = c.drop("embedding")
    heads = _best(bare.where("i_kind < 4"), ["i_part", "i_long", "i_kind"], n, "nth", "chunk_id").drop("nth").unionByName(bare.where("i_kind = 4"))
    where = F.col("part") == F.col("i_part")
    even = (F.col("kind") == 0) & (F.col("i_kind") == 0) & (F.col("long") == F.col("i_long"))
    pair = lambda d: d.select("key", F.col("chunk_id").cast(common).alias("i_key"))
    bounded, rest = q.drop("vector").where("kind < 4"), q.drop("vector").where("kind = 4")
    out = found.unionByName(pair(bounded.join(heads, where).where(~even))).unionByName(pair(rest.join(bare, where)))
    return out.select(F.col("key").cast(asked).alias("query_id"), F.col("i_key").cast(had).alias("chunk_id")).distinct()


def vector_search_by_topic(queries: DataFrame, chunks: DataFrame, k: int, near_by: DataFrame | None = None) -> DataFrame:
    """The k best distinct chunks of each query's plan. queries: query_id, plan_id, vector, topics.

    With topics: the nearest 6k chunks, of these the first 2k of the topics; where there are none, the plan's first 2k chunks of the
    topics; where there are none, its first 2k. Without topics: the nearest 2k; where there are none, the plan's first 2k. A null or
    empty vector has no nearest chunks, a chunk without an embedding is near to none. Then repeated contents go, and
    the first k of the others stay. All stages are bounded lists, so the first that has rows is chosen by one window over their union
    and nothing is searched twice. path says which one it was. near_by (query_id, chunk_id), if given, are the only pairs whose vectors
    are compared, as an index chose them; else products of blocks choose pairs among which the nearest are (_nearest), so that no list of all
    pairs is moved."""
    asked = queries.select("query_id", "plan_id", "vector", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"))
    bare, wide = _bare(chunks), F.size("topics") > 0
    near, able = asked.where(F.size("vector") > 0), bare.where(F.size("embedding") > 0)
    near_by = _nearest(near, able, 6 * k) if near_by is None else near_by
    pairs = _scored(near.join(near_by, "query_id"), able, ["plan_id", "chunk_id"], "topics", "topic", "_text")
    near = _best(pairs, ["query_id"], F.when(wide, 6 * k).otherwise(2 * k), "n", F.desc("score"), "chunk_id")
    near = _best(near.where(~wide | F.array_contains("topics", F.col("topic"))), ["query_id"], 2 * k, "n", F.desc("score"), "chunk_id")
    listed = asked.select("query_id", "plan_id", F.explode("topics").alias("topic"))
    found = near.select("query_id", "chunk_id", "_text", "score", "n", F.lit(0).alias("stage"))
    found = found.unionByName(_first_chunks(listed, bare, k, 1, ["plan_id", "topic"])).unionByName(_first_chunks(asked.select("query_id", "plan_id"), bare, k, 2, ["plan_id"]))
    found = found.withColumn("first", F.min("stage").over(W.partitionBy("query_id"))).where("stage = first and _text is not null")
    one = _best(found, ["query_id", "_text"], 1, "c", "n")
    path = F.element_at(F.array(*[F.lit(x) for x in ("vector", "first of topic", "first of plan")]), F.col("stage") + 1)
    score = F.when(F.col("score") != 0, F.col("score")).otherwise(DEFAULT_SCORE)
    ranked = _best(one, ["query_id"], k, "rank", "n").select("query_id", "chunk_id", score.alias("score"), "rank", path.alias("path"))
    return _shown(ranked, chunks)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int, near_by: DataFrame | None = None) -> DataFrame:
    """vector_search_by_topic without topics. queries: query_id, plan_id, vector."""
    return vector_search_by_topic(queries.select("query_id", "plan_id", "vector", F.array().cast("array<string>").alias("topics")), chunks, k, near_by)


def section_patterns(sections: str | Column) -> Column:
    """Fragments that a chunk's section must contain, in lower case: of each name, without leading #, the first 40 characters;
    of a numbered one also the number with the next four words. Fragments are regular expressions of at most 40
    characters after escaping, so a long one with signs is shorter; one that is cut inside an escape ends in a backslash."""
    ws = F.lit(" ")
    trimmed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    norm = lambda x: trimmed(F.regexp_replace(F.ltrim(F.regexp_replace(x, r"\s", " ")), r"^#{1,6}\s+", ""))
    group = lambda x, i: F.regexp_extract(x, r"^(\d+(?:\.\d+)+) (.+)", i)
    words = lambda x: F.array_join(F.slice(F.split(group(x, 2), " "), 1, 4), " ")
    numbered = lambda x: F.trim(F.substring(F.concat(group(x, 1), ws, words(x)), 1, 40))
    pair = lambda x: F.array(F.trim(F.substring(x, 1, 40)), F.when((group(x, 1) != "") & (F.length(words(x)) >= 2), numbered(x)))
    parts = F.flatten(F.transform(F.filter(F.transform(sections, norm), lambda x: x != ""), pair))
    long = F.filter(parts, lambda f: F.length(f) >= 2)
    return F.array_distinct(F.transform(long, lambda f: F.lower(F.substring(F.regexp_replace(f, r"([.*+?^${}()|\[\]\\])", r"\\$1"), 1, 40))))


def _sections(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, plan_id, section) of the sections that one of a query's patterns is in. Patterns are compared with
    the distinct sections of the plan, not with its chunks. A query of which a pattern is cut inside an escape finds none."""
    has = F.when(F.size("vector") > 0, section_patterns("sections"))
    cut = F.exists("patterns", lambda p: F.length(F.regexp_extract(p, r"(\\*)$", 1)) % 2 == 1)
    asked = queries.select("query_id", "plan_id", has.alias("patterns")).where(~cut).select("query_id", "plan_id", F.explode("patterns").alias("p"))
    literal = asked.select("query_id", "plan_id", F.regexp_replace("p", r"\\(.)", "$1").alias("p"))
    names = chunks.select("plan_id", "section").where("section is not null").distinct()
    return literal.join(names, "plan_id").where(F.contains(F.lower("section"), F.col("p"))).select("query_id", "plan_id", "section").distinct()


def search_by_section(queries: DataFrame, chunks: DataFrame, k: int, near_by: DataFrame | None = None) -> DataFrame:
    """The nearest k chunks in the sections that queries (query_id, plan_id, vector, sections, perhaps topics) name; where no chunk
    is in one, vector_search_by_topic's (without topics: vector_search's). Chunks are not freed of repeats here, and one without
    an embedding does not count, but keeps the search in its section."""
    named = _sections(queries, chunks)
    here = named.join(queries.select("query_id", "vector"), "query_id")
    hits = _scored(here, chunks.where(F.size("embedding") >= 0).select("chunk_id", "plan_id", "section", "embedding"), ["plan_id", "section"])
    ranked = _best(hits, ["query_id"], k, "rank", F.desc("score"), "chunk_id").withColumn("path", F.lit("section"))
    rest = queries.join(named.select("query_id").distinct(), "query_id", "left_anti")
    topics = F.col("topics") if "topics" in queries.columns else F.array().cast("array<string>")
    others = vector_search_by_topic(rest.select("query_id", "plan_id", "vector", topics.alias("topics")), chunks, k, near_by)
    return _shown(ranked, chunks).unionByName(others)


def rerank_hits(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """0.7 of the vector's score and 0.3 of the share of the question's keywords in the chunk; the best k."""
    q = questions.select("query_id", rerank_keywords("text").alias("kw"))
    low = F.lower("content")
    share = F.when(F.size("kw") > 0, F.size(F.filter("kw", lambda x: F.contains(F.col("_low"), x))) / F.size("kw")).otherwise(0.0)
    scored = hits.join(q, "query_id").withColumn("_low", low).withColumn("final", F.round(0.7 * F.col("score") + 0.3 * share, 9)).drop("_low", "kw", "rank")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("final"), "chunk_id"))).where(F.col("rank") <= k)


def context_lines(ranked: DataFrame) -> Column:
    """A chunk as a part of a prompt, under its section's name."""
    name = F.coalesce(F.nullif(F.col("section"), F.lit("")), F.lit(NO_SECTION))
    return F.concat(F.lit("["), name, F.lit("]\n"), "content", F.lit("\n\n"))


def within_budget(ranked: DataFrame, limit: int, text: Column | None = None) -> DataFrame:
    """in_budget: whether a chunk's line ends within the limit, all before it counted."""
    total = F.sum(F.length(F.col("content") if text is None else text)).over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranked.withColumn("in_budget", total <= limit)


def retrieve_context(questions: DataFrame, chunks: DataFrame, retrieve: int = 12, use: int = 6, limit: int = 12_000, near_by: DataFrame | None = None) -> DataFrame:
    """The sources of each question (query_id, plan_id, text, vector, sections): by section where the question's course names some
    and a chunk is in them; else by section's fallback, without topics, where it names some; else by the topics that are inferred from its
    text. Twelve are retrieved, six stay after re-ranking; in_budget marks those whose lines make up the prompt."""
    asked = infer_topics(questions)
    topics = F.when(F.size("sections") > 0, F.array().cast("array<string>")).otherwise(F.col("topics"))
    hits = search_by_section(asked.withColumn("topics", topics), chunks, retrieve, near_by)
    best = rerank_hits(hits, questions, use)
    shown = within_budget(best, limit, context_lines(best))
    return shown.select("query_id", "chunk_id", "rank", "final", "section", F.substring("content", 1, 120).alias("preview"), "path", "in_budget", "content")


def context_of(sources: DataFrame) -> DataFrame:
    """The context of each question's prompt."""
    lines = F.array_sort(F.collect_list(F.struct("rank", context_lines(sources).alias("line"))))
    return sources.where("in_budget").groupBy("query_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("context"))


def reuse_candidates(requests: DataFrame, index: DataFrame, own: float = 0.88, public: float = 0.92, overlap: float = 0.15, near: int = 20) -> DataFrame:
    """For each request the first of the nearest earlier lessons that passes: the owner's own before other owners' public
    ones, of another plan, near enough in vector and keywords. Both: lesson_id, plan_id, owner_id, topic, vector; index
    also is_public. Products of blocks of vectors choose the nearest (own ones within the owner), whose texts and exact scores are then
    fetched. Of index rows with one vector the first near + 1 can be among the nearest, so no others are compared."""
    asked = requests.select("lesson_id", "plan_id", "owner_id", "topic", "vector")
    i = index.select(*[F.col(c).alias(f"i_{c}") for c in ("lesson_id", "plan_id", "owner_id", "topic", "vector", "is_public")])
    bare = i.select("i_lesson_id", "i_owner_id", "i_vector", "i_is_public")

    def nearest_of(rows: DataFrame, threshold: float, mine: bool) -> DataFrame:
        part = (lambda c: F.col(c)) if mine else (lambda c: F.lit(0).cast(dict(bare.dtypes)["i_owner_id"]))
        first = _best(rows, ["i_vector", "i_owner_id"] if mine else ["i_vector"], near + 1, "copy", "i_lesson_id")
        pairs = nearest_pairs(
            asked.select(F.col("lesson_id").alias("key"), "vector", part("owner_id").alias("part")),
            first.select(F.col("i_lesson_id").alias("i_key"), "i_vector", part("i_owner_id").alias("i_part")), threshold, near,
        )
        return pairs.select(F.col("key").alias("lesson_id"), F.col("i_key").alias("i_lesson_id"), F.lit(mine).alias("own"))

    pairs = nearest_of(bare, own, True).unionByName(nearest_of(bare.where("i_is_public"), public, False))
    both = with_length(asked, "vector").join(pairs, "lesson_id").join(with_length(i, "i_vector"), "i_lesson_id").withColumn("score", pair_cosine("vector", "i_vector"))
    ours = F.col("own") & (F.col("owner_id") == F.col("i_owner_id")) & (F.col("score") >= own)
    both = both.where(ours | (~F.col("own") & F.col("i_is_public") & (F.col("score") >= public))).drop("vector", "i_vector", "vector_length", "i_vector_length", "i_is_public")
    order = [F.desc("score"), F.asc("i_lesson_id")]
    nearest = _best(both, ["lesson_id", "own"], near, "n", *order)
    passed = nearest.where((F.col("plan_id") != F.col("i_plan_id")) & (F.col("own") | (F.col("owner_id") != F.col("i_owner_id"))))
    passed = passed.where(jaccard(F.array_distinct(reuse_keywords("topic")), F.array_distinct(reuse_keywords("i_topic"))) >= overlap)
    return _best(passed.drop("n"), ["lesson_id"], 1, "n", F.desc("own"), *order).select("lesson_id", F.col("i_lesson_id").alias("source_id"), "score", "own")


def vectorize(docs: DataFrame, key: str, text: str, size: int = 384, model: Callable[[list[str]], list[list[float]]] | None = None, given: str | None = None) -> DataFrame:
    """key and embedding of rows with words. Vectors that a row brings along (the column given) pass through. The others are made by
    the model, a function from a list of texts to their vectors that runs on Arrow batches in the tasks, or without one by hashed term frequencies,
    weighted by inverse document frequency over all rows, of length one; then texts without words are left out."""
    kept = docs.where(F.size(given) > 0).select(key, F.col(given).cast("array<float>").alias("embedding")) if given else None
    rest = docs.where(F.coalesce(F.size(given) <= 0, F.lit(True))) if given else docs
    made = _modelled(rest, key, text, model) if model else _weighted(rest, docs, key, text, size)
    return made if kept is None else made.unionByName(kept)


def _modelled(docs: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def embedded(batch: pd.Series) -> pd.Series:
        return pd.Series(list(model(batch.fillna("").tolist())), dtype=object)

    return docs.select(key, embedded(text).alias("embedding"))


def _weighted(docs: DataFrame, every: DataFrame, key: str, text: str, size: int) -> DataFrame:
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    rows = lambda d: HashingTF(numFeatures=size, inputCol="_w", outputCol="_tf").transform(d.select(key, words.alias("_w")).where(F.size("_w") > 0))
    weighed = IDF(inputCol="_tf", outputCol="_v").fit(rows(every)).transform(rows(docs))
    return Normalizer(inputCol="_v", outputCol="_n").transform(weighed).select(key, vector_to_array("_n", "float32").alias("embedding"))


def ann_search(queries: DataFrame, chunks: DataFrame, k: int, index: QuantisedIndex | None = None, filed: DataFrame | None = None, reread: int = 4) -> DataFrame:
    """vector_search whose nearest chunks are chosen by an inverted file of codes; so many times k vectors of each query are read
    in full. The index and the filed chunks can be kept between calls."""
    index = index or fit_index(chunks)
    near = queries.select("query_id", F.lit(None).cast(chunks.schema["chunk_id"].dataType).alias("chunk_id")).limit(0) if index is None else candidates(queries, file_chunks(chunks, index) if filed is None else filed, index, reread * k)
    return vector_search(queries, chunks, k, near)


def lessons_to_index(lessons: DataFrame, plans: DataFrame, index: DataFrame) -> DataFrame:
    """Lessons of known plans that the index lacks, with owner and visibility."""
    return lessons.join(index.select("lesson_id"), "lesson_id", "left_anti").join(plans.select("plan_id", "owner_id", "is_public"), "plan_id").select("lesson_id", "plan_id", "owner_id", "is_public")


def sync_public(index: DataFrame, plans: DataFrame) -> DataFrame:
    now = plans.select("plan_id", F.col("is_public").alias("_now"))
    return index.join(now, "plan_id", "left").withColumn("is_public", F.coalesce("_now", "is_public")).drop("_now")
