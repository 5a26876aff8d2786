"""The pipeline's stages against brute force over their own inputs."""

import random

import pytest

pytest.importorskip("lectern.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F

from lectern.llm import common
from lectern.llm import op02_near_texts as near


def brute_kept(rows):
    """The smallest id of each group that pairs of five-word Jaccard of 0.8 or more connect."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root, ids, having = {i: i for i in sets}, sorted(sets), {}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in ids:
        for x in sets[i]:
            having.setdefault(x, []).append(i)
    for b in ids:
        for a in {a for x in sets[b] for a in having[x] if a < b}:
            if find(a) != find(b) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def test_stages_take_effect(spark, sf):
    docs, seen = common.read(spark, sf, "documents"), {}
    for name, f in pipeline.STAGES:
        out = common.stage(f(spark, docs, sf), name)
        seen[name] = (docs, out)
        docs = out
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == pipeline.COLUMNS
    before, after = seen["near_dedup"]
    assert {r.doc_id for r in after.collect()} == brute_kept([(r.doc_id, r.text) for r in before.collect()])
    windows, repeated = {}, 0
    for r in sorted(seen["passage_dedup"][1].collect(), key=lambda r: r.doc_id):
        w = r.text.split()
        for k in range(len(w) - 49):
            repeated += windows.setdefault(tuple(w[k : k + 50]), r.doc_id) != r.doc_id
        assert r.n_chars == len(r.text)
    assert repeated == 0
    packed = seen["packing"][1]
    assert packed.select("doc_id").distinct().count() == seen["benchmark_free"][1].count()


def test_run_is_its_stages(spark, sf):
    assert pipeline.run(spark, sf).count() > 0


def test_near_dedup_finds_copies_of_five_word_jaccard_of_four_fifths(spark, sf):
    rng, rows = random.Random(5), []
    for g in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([60, 150, 400]))]
        for k in range(5):
            copy = list(words)
            for _ in range(k * len(words) // 100):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(4000)}"
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(2000, ""), (2001, None), (2002, "Two words"), (2003, "two  WORDS"), (None, "two words"), (2004, rows[0][1].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [r.doc_id for r in pipeline.near_dedup(spark, docs, sf).collect()]
    assert None in kept and sorted(i for i in kept if i is not None) == sorted(brute_kept([r for r in rows if r[0] is not None]))


def test_large_groups_with_strangers_are_compared_in_blocks(spark, sf, monkeypatch):
    """Copies of one text that are each far from the ends of their keys, and texts that share half of it."""
    monkeypatch.setattr(near, "CHUNK", 16)
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(300)], []
    for k in range(120):
        copy = list(base)
        for j in range(k % 9):
            copy[(37 * j + 11 * k) % 300] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(base[:200] + [f"z{rng.randrange(10**6)}" for _ in range(30 + k)])) for k in range(40)]
    asked = []
    inner = near._in_blocks
    monkeypatch.setattr(near, "_in_blocks", lambda q, *more: asked.append(q.count()) or inner(q, *more))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, sf).collect()} == brute_kept(rows) and asked[0] > 30


def test_stages_define_every_case(spark, sf):
    """Null ids and texts, empty and repeated rows, ids that repeat with other texts, other columns, no rows at all."""
    long = " ".join(f"word{k % 977}x{k % 13}" for k in range(20_000))
    rows = [(None, None), (None, "a b"), (1, None), (1, "other words that are no copy of anything here"), (1, None), (2, ""), (3, long), (4, long), (4, long)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("clash") for c in ("h", "fp", "v", "key", "text_hash", "score", "tag", "at", "class")})
    out = common.stage(pipeline.near_dedup(spark, docs, sf), "t")
    got = sorted(((r.doc_id, len(r.text or "")) for r in out.collect()), key=str)
    assert got == sorted([(None, 0), (None, 3), (1, 0), (1, 45), (3, len(long))], key=str)
    for name, f in pipeline.STAGES:
        result, none = common.stage(f(spark, docs, sf), "t"), f(spark, docs.limit(0), sf)
        assert none.count() == 0, name
        if name != "packing":
            assert result.columns == none.columns == pipeline.COLUMNS
        else:
            assert result.agg(F.sum("length")).first()[0] > 20_000 and result.where("doc_id is null").count() == 2
