"""The operators against brute force, and the cases that every one must define."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

pytest.importorskip("lectern.llm")

import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from lectern.llm import common, encoding
from lectern.llm import op01_quality_gam as o1
from lectern.llm import op02_simhash_golay as o2
from lectern.llm import op03_html_extraction as o3
from lectern.llm import op04_substring_dedup as o4
from lectern.llm import op05_token_counts as o5
from lectern.llm import op06_token_output as o6
from lectern.llm import op07_decontamination as o7
from lectern.llm import op08_quality_rules as o8
from lectern.llm import op09_packing as o9
from lectern.llm import op10_toxicity as o10

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
BYTE, WORD, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
CLASHING = ["score", "fp", "tag", "at", "h", "x", "words", "keep_text", "class", "rank", "copy", "hits", "a", "b", "row", "node"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ids out of order; nulls, empties, repeats, ties, copies, near copies, shared passages, one very long text."""
    rng = random.Random(3)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    out = [(None, "one two three"), (7, None), (3, ""), (9, " \n\t "), (4, "short text"), (4, "short text")]
    out += [(20 + k, base) for k in range(4)]
    out += [(30 + k, base.replace("alpha", "Alpha", 1) + f" end{k}") for k in range(4)]
    out += [(50 - k, f"{sentence(rng, 40)} {passage}\n{sentence(rng, 30)}") for k in range(6)]
    out += [(60 + k, sentence(rng, rng.randrange(1, 80))) for k in range(40)]
    out += [(200, " ".join(sentence(rng, 300) for _ in range(40)))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows with columns whose names the operators use inside."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    ids = [r[0] for r in rows]
    return spark.createDataFrame([(i, int(i % 5 != 0) if i is not None else 1, int(i is not None and i % 7 == 0), "clash") for i in ids] + [(20, None, None, ""), (999, 0, 1, "")], "doc_id long, quality int, toxic int, score string")


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    text = rows[10][1]
    return spark.createDataFrame([(1, text), (2, "Short  TEXT"), (3, None), (4, ""), (None, text), (11, rows[-1][1][:400])], "item_id long, text string")


def empty(docs):
    return docs.limit(0)


def by_id(out):
    return sorted(out, key=lambda r: tuple((x is not None, x) for x in r))


def test_every_operator_takes_an_empty_table(spark, docs, labels, benchmark):
    e, none = empty(docs), empty(labels)
    assert o1.score_quality(e, labels).count() == 0
    assert o2.near_duplicates(e).count() == 0
    assert o3.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert o4.substring_dedup(e).count() == 0
    assert o5.token_counts(e, PIECES).count() == 0
    assert o6.token_output(e, common.shared_path(spark, "t"), BYTE, "byte", 2).count() == 0
    assert o7.hit_spans(e, benchmark).count() == 0
    assert o8.quality_rules(e, labels).count() == 0
    assert o9.packing(e, WORD, "word", 1).count() == 0
    assert o10.score_toxicity(e, labels).count() == 0
    assert o1.score_quality(docs, none).agg(F.min("quality_score"), F.max("quality_score")).first() == (0.5, 0.5)
    assert o8.quality_rules(docs, none).where("rule is not null").count() == 0
    assert o10.score_toxicity(docs, none).where("score >= 0.7").count() == 0
    assert o7.hit_spans(docs, empty(benchmark)).where("size(begins) > 0").count() == 0


def test_scores_and_rules_return_every_row(docs, labels, rows):
    for out, col in ((o1.score_quality(docs, labels).select("doc_id", "quality_score"), "quality_score"), (o10.score_toxicity(docs, labels), "score")):
        got = out.collect()
        assert len(got) == len(rows) and all(0 <= r[col] <= 1 for r in got)


def test_quality_model_learns_held_out_rows():
    rng = random.Random(5)
    good = [sentence(rng, rng.randrange(5, 200)) for _ in range(300)]
    bad = [" ".join(f"{w}$$$" for w in sentence(rng, 60).split()) for _ in range(60)] + [" ".join([w] * 12) for w in WORDS * 3] + [sentence(rng, 50).upper() + "!!" for _ in range(60)]
    x = np.array([o1.describe(t) for t in good + bad])
    y = np.array([1.0] * len(good) + [0.0] * len(bad))
    learn = np.arange(len(y)) % 5 != 0
    s = o1.fit(x[learn], y[learn]).score(x)
    assert ((s >= 0.5) == (y == 1))[~learn].mean() > 0.97


def naive_description(text):
    """The statistics of describe(), one by one."""
    b = (text or "").encode()
    words = b.split()
    n = len(words)
    if not n:
        return [0.0] * len(o1.FEATURES)
    share = lambda chars: sum(b.count(bytes([c])) for c in chars) / len(b)
    upper, lower = bytes(range(65, 91)), bytes(range(97, 123))
    lines = [x for x in b.split(b"\n") if x.strip()]
    fives = [tuple(words[k : k + 5]) for k in range(n - 4)]
    has = lambda w, chars: any(c in chars for c in w)
    same = [float(k > 0 and words[k] == words[k - 1]) for k in range(n)]
    blocks = [range(a, min(a + 64, n)) for a in range(0, n, 64)]
    most = lambda f: max(sum(f(k) for k in r) / max(len(r), 16) for r in blocks)
    p = [b.count(bytes([c])) / len(b) for c in set(b)]
    return [
        np.log1p(n), sum(map(len, words)) / n, share(upper), share(b"0123456789"), share(b"#*$%&"), share(b"|"), share(b"!?"), share(b"<>"), share(b".,;:"), share(b" \t\n\x0b\x0c\r"),
        sum(c > 127 for c in b) / len(b), len(lines) / n, len(set(words)) / n, max(words.count(w) for w in set(words)) / n, sum(same) / n, 1 - len(set(fives)) / len(fives) if fives else 0.0,
        1 - len(set(lines)) / len(lines), -sum(x * np.log(x) for x in p), most(lambda k: has(words[k], b"#*$%&")), most(lambda k: has(words[k], b"|")), most(lambda k: b"!" in words[k]),
        most(lambda k: has(words[k], upper) and not has(words[k], lower) and len(words[k]) > 1), most(lambda k: same[k]), min([len({words[k] for k in r}) / len(r) for r in blocks if len(r) >= 16], default=1.0),
        sum(len(w) > 20 for w in words) / n, sum(len(w) < 3 for w in words) / n,
    ]


def test_statistics_of_the_model_match_naive_ones(rows):
    rng = random.Random(17)
    texts = [t for _, t in rows if t is None or len(t) < 5000] + [" ".join(rng.choice(["ABC", "a!", "##", "x|y", "b", "b", "<i>", "é1", "\n", "Ab?", "n" * 30]) for _ in range(rng.randrange(200))) for _ in range(80)]
    for t in texts:
        assert np.allclose(o1.describe(t), naive_description(t), atol=1e-9), t


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(3)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = o1.fit(x, y, rounds=5, pair_rounds=3, n_pairs=2)
    for row, got in zip(x[:60], m.score(x[:60])):
        at = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, at)) + sum(t[to_i[at[i]], to_j[at[j]]] for i, j, to_i, to_j, t in m.pairs)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12


def test_pair_tables_capture_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = o1.fit(x, y, rounds=20, pair_rounds=60, n_pairs=1)
    assert {m.pairs[0][0], m.pairs[0][1]} == {0, 1} and ((m.score(x) > 0.5) == (y == 1)).mean() > 0.9


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(len(w) - 3, 1))] if w else []
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(ids, prints):
    low = {p: min(i for i, q in zip(ids, prints) if q == p) for p in prints}
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in low:
        for q in low:
            if bin(p ^ q).count("1") <= 4:
                root[find(p)] = find(q)
    return {p: min(low[q] for q in low if find(q) == find(p)) for p in low}


def test_simhash_components_match_all_pairs(docs, rows):
    named = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    want = brute_components([i for i, _ in named], [p for _, p in named])
    got = [r for r in o2.near_duplicates(docs).collect() if r.doc_id is not None]
    assert len(got) == len(named)
    assert all(want[r.fp % 2**64] == r.component_id for r in got)


@pytest.mark.parametrize("every", [1, 20, 1000])
def test_rows_meet_the_one_of_their_key(spark, monkeypatch, every):
    monkeypatch.setattr(common, "COMMON", every)
    rng = random.Random(5)
    data = [(rng.choice([0, rng.randrange(200)]), i) for i in range(4000)]
    rows = spark.createDataFrame(data, "k long, i long")
    ones = rows.groupBy("k").agg(F.count("*").alias("n_rows")).where("k <> 3").withColumn("x", F.col("k") * 7)
    got = common.with_one(rows, ones, "k", 4000)
    assert got.columns == ["k", "i", "x"]
    assert sorted(map(tuple, got.collect())) == sorted((k, i, 7 * k) for k, i in data if k != 3)
    assert common.with_one(rows.where("k < 0"), ones, "k", 0).count() == 0


def test_a_common_key_is_not_shuffled_into_one_task(spark):
    rows = spark.range(0, 40000, 1, 8).select(F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id")).alias("k"), "id")
    ones = rows.groupBy("k").agg(F.count("*").alias("n_rows"))
    got = common.with_one(rows, ones, "k", 40000)
    sizes = [r["count"] for r in got.where("k = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 26666 and max(sizes) < 26666 / 7


@pytest.mark.parametrize("every", [1, 1000])
def test_components_of_hubs_and_chains(spark, monkeypatch, every):
    monkeypatch.setattr(common, "COMMON", every)
    star = [(1000, k) for k in range(1001, 1900)]  # the hub is the smallest node
    top = [(k, 5000) for k in range(4000, 4900)]  # the hub is the largest node
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = spark.createDataFrame(star + top + chain + chain + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    want = {n: 1000 for n in range(1000, 1900)} | {n: 4000 for n in [*range(4000, 4900), 5000]} | {n: 100 for n in range(100, 161)}
    assert {n: got.get(n, n) for n in want} == want and set(got) <= set(want)


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for v in (x, y):
        r, k = o2.keys_of(v)
        keys.append(set(zip(r.tolist(), k.tolist())))
    assert {r for r, _ in keys[0] & keys[1]} == set(range(3000))


@pytest.mark.parametrize("hot", [o2.HOT, 40])
def test_long_runs_are_compared_in_chunks(spark, monkeypatch, hot):
    rng = np.random.default_rng(2)
    fps = {int(x) for x in rng.integers(0, 2**20, 300)}  # all share two segments of zeros
    nodes = spark.createDataFrame([(k, f) for k, f in enumerate(sorted(fps))], "node long, fp long")
    monkeypatch.setattr(o2, "RUN", 32)
    monkeypatch.setattr(o2, "HOT", hot)
    got = {r.node: r.component for r in common.components(o2.links(nodes)).collect()}
    fs = sorted(fps)
    want = brute_components(list(range(len(fs))), fs)
    assert all(got.get(k, k) == want[f] for k, f in enumerate(fs))


def brute_removed(rows):
    first, out = {}, []
    named = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    for i, t in named:
        w = (t or "").split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in rows:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return by_id(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_substring_dedup_matches_brute_force(docs, rows, batches):
    assert by_id(map(tuple, o4.substring_dedup(docs, batches).collect())) == brute_removed(rows)


def test_window_index_compacts_without_loss(spark, docs, rows, monkeypatch):
    tables = spark.catalog.listTables()
    monkeypatch.setattr(o4, "MAX_RUNS", 2)
    assert by_id(map(tuple, o4.substring_dedup(docs, 6).collect())) == brute_removed(rows)
    assert spark.catalog.listTables() == tables  # a query leaves no table behind
    index = o4.FingerprintIndex(spark)
    index.add(docs)
    index.add(docs)
    old = list(index.runs)
    before = spark.table(old[0]).union(spark.table(old[1])).count()
    index.compact(force=True)
    assert len(index.runs) == 1 and spark.table(next(iter(index.runs))).count() == before and not any(spark.catalog.tableExists(r) for r in old)
    index.drop()
    assert not index.runs and spark.catalog.listTables() == tables


def test_passages_of_very_many_documents_and_repeats_within_one(spark, monkeypatch):
    """Hot fingerprints and windows, over several batches of a task, ids out of order and ids that repeat."""
    rng = random.Random(31)
    hot, line = sentence(rng, 25), sentence(rng, 14)
    rows = [((37 * k) % 211, f"{sentence(rng, 6)} {hot} {sentence(rng, 9)}" + (f" {line}" * (k % 5) if k % 3 == 0 else "")) for k in range(200)]
    rows += [(300, " ".join([line] * 60)), (301, " ".join([line] * 40)), (5, f"{hot} {sentence(rng, 20)}"), (5, f"{sentence(rng, 20)} {hot}"), (302, "a " * 300), (303, "a " * 200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(common, "BATCH_ROWS", "7")
    assert by_id(map(tuple, o4.substring_dedup(d).collect())) == brute_removed(rows)
    monkeypatch.setattr(o4, "KNOWN", 5)
    assert by_id(map(tuple, o4.substring_dedup(d).collect())) == brute_removed(rows)
    assert o4.prints(d).where("k <> h").count() > 300


def brute_hits(rows, items, window=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))

    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - window, 0) + 1 if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[k : k + n]) in wins and k + n <= len(w):
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return by_id(out)


@pytest.mark.parametrize("block,shard", [(4_000_000, 400_000), (2000, 50)])
def test_fm_index_spans_match_brute_force(docs, rows, benchmark, monkeypatch, block, shard):
    monkeypatch.setattr(o7, "BLOCK_WORDS", block)
    monkeypatch.setattr(o7, "SHARD_WORDS", shard)
    got = o7.hit_spans(docs, benchmark).select("doc_id", "n_words", o7._hits().alias("n"), F.array_join("items", ",").alias("i")).collect()
    assert by_id(map(tuple, got)) == brute_hits(rows, [tuple(r) for r in benchmark.collect()])


def test_shards_of_words_are_bounded_within_a_batch():
    texts = [None, "", *(" ".join(["word"] * (1 + k % 90)) for k in range(300)), "x " * 5000, "last"]
    batches = [o7.pa.RecordBatch.from_arrays([o7.pa.array(range(len(texts))), o7.pa.array(texts)], names=["doc_id", "text"])] * 2
    got = list(o7.shards(iter(batches), ["doc_id"], 1000))
    assert max(sum(map(len, words[:-1])) for _, words in got) < 1000 and len(got) > 20
    assert [i for held, _ in got for b in held for i in b["doc_id"].to_pylist()] == [*range(len(texts))] * 2
    assert [w for _, words in got for w in words] == [o7.words_of(t) for t in texts] * 2


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(4)
    s = np.append(0, rng.integers(0, 4, 500))
    s = np.append(s, 0)
    f = o7.FMIndex(s)
    pats = rng.integers(1, 4, (40, 3))
    lo, hi = f.search(pats)
    for p, a, b in zip(pats, lo, hi):
        want = {k for k in range(len(s) - 2) if (s[k : k + 3] == p).all()}
        assert set(f.locate(np.arange(a, b)).tolist()) == want and b - a == len(want)


def test_cut_spans_leaves_the_rest():
    assert o7.cut_spans("Keep, this! DROP these words; and this.", [2], [5]) == "Keep, this! ; and this."


ODD = ["It's we'll DON'T 'said x''s", "tab\there  two  spaces\n\nblank \n line\n", " lead", "İstanbul ΣΑΣ ß ½² ①", "日本語 text 中文。ok", "<|endoftext|> x", "a\x1cb \x85 c", "\x00nul", "", "\n"]


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_chunked_encoding_is_the_tokenizers_own(kind, path, rows):
    rng = random.Random(0)
    texts = ODD + [t for _, t in rows if t] + ["".join(rng.choice("aB'sd .\n\té½3_-ß! İ日́") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    c = encoding.ChunkEncoder(path, kind)
    assert c.ids_bytes(texts) == want == c.ids_bytes(texts) and c.ids_bytes([]) == []
    c.odd.limit = c.pieces.limit = 20_000  # generations come and go
    assert [x for t in texts for x in c.ids_bytes([t])] == want


def test_caches_are_bounded_in_bytes():
    made = []
    c = encoding.Remembered(lambda k: made.append(k) or k.encode(), 2000)
    for k in range(1000):
        assert c[f"key {k}"] == f"key {k}".encode() and c["again"] == b"again"
        assert sum(encoding.ENTRY_BYTES + 2 * len(x) for x in [*c, *c.old]) <= 4000
    assert made.count("again") == 1 and c["x" * 999] and "x" * 999 not in c


@pytest.mark.parametrize("kind,path", [("byte", BYTE), ("word", WORD)])
def test_added_tokens_are_encoded_as_by_a_fresh_tokenizer(kind, path):
    texts = ["end <|endoftext|> x", "a<|endoftext|>b", "<|startoftext|> One\n<|endoftext|>", "<|ENDOFTEXT|> <|endoftext |>", *ODD]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoding.ChunkEncoder(path, kind).ids_bytes(texts) == want


def test_token_files_round_trip(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(o6, "FRAME_BYTES", 1024)
    monkeypatch.setattr(o6, "FILE_FRAMES", 2)
    path = common.shared_path(spark, "tokens")
    got = sorted(o6.token_output(docs, path, BYTE, "byte", 2).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(BYTE)
    ids = {}
    for i, t in rows:
        ids[i] = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))
        at += r.n_tokens
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 8
    some = o6.read_tokens(spark, path, wanted={20, 200}, with_ids=True).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {20: ids[20], 200: ids[200]}


def test_frames_are_checked_and_read_alone():
    w = o6.FrameWriter(frame_bytes=64)
    parts = [p for k in range(40) for p in w.add(k, np.arange(k, dtype="<u4").tobytes())] + list(w.close())
    data = b"".join(p + o6.MAGIC for p in parts)
    f = o6.FrameFile.of(data)
    touched = []
    f.frame = lambda k, g=f.frame: touched.append(k) or g(k)
    assert dict(f.documents({30}))[30] == np.arange(30, dtype="<u4").tobytes() and len(touched) == 1
    bad = bytearray(data)
    bad[f.frames[0]["offset"] + 12] ^= 1
    with pytest.raises(Exception):
        o6.FrameFile.of(bytes(bad)).frame(0)


def test_packing_fills_without_gaps(docs, rows):
    got = o9.packing(docs, WORD, "word", 1).collect()
    tok = Tokenizer.from_file(WORD)
    want = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == sum(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= o9.CAPACITY
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in rows}
    assert all(zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in got)


@pytest.mark.parametrize("tokens", [lambda k: 1, lambda k: 5, lambda k: 1 + k % 16, lambda k: 1 + k * k % 5000])
def test_sequences_have_little_padding(spark, tokens):
    """Every id lies in one piece, and the padding is bounded, whatever the lengths."""
    d = spark.range(60_000).select(F.col("id").alias("doc_id"), F.udf(lambda k: "a " * (tokens(k) - 1), "string")("id").alias("text")).where("doc_id < 60000")
    if tokens(70) > 100:
        d = d.where("doc_id < 4000")
    out = common.stage(o9.packing(d, WORD, "word", 1), "packed")
    per_doc = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.sort_array(F.collect_list(F.struct("start", "length"))).alias("p")).collect()
    assert len(per_doc) == d.count()
    for r in per_doc:
        assert r.n == r["all"] == tokens(r.doc_id) and [p.start for p in r.p] == [sum(q.length for q in r.p[:k]) for k in range(len(r.p))]
    total, bins, most = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("*"), F.max("n")).first()
    assert most <= o9.CAPACITY and total >= (0.94 if tokens(70) > 100 else 0.97) * o9.CAPACITY * (bins - 2)


def test_cut_is_exact_and_nearly_full():
    for n in range(0, 6000, 7):
        pieces = o9.cut(n)
        assert sum(p for p, _ in pieces) == n and all(p * k <= o9.CAPACITY for p, k in pieces)


def test_piece_counts_match_the_unigram_tokenizer(rows):
    v = o5.vocabulary(PIECES)
    words = sorted({w for _, t in rows for w in (t or "").split()}) + ["日本語", "😀😀a", "ab😀", ""]
    for pieces in (v, [(p, float(-k)) for k, (p, _) in enumerate(v)]):
        tok, c = Tokenizer(models.Unigram(pieces, 0, False)), o5.PieceCounter(pieces)
        assert [c.count(o5.BEGIN + w) for w in words] == [len(e.ids) for e in tok.encode_batch([o5.BEGIN + w for w in words], add_special_tokens=False)]


def test_token_counts_rows(docs, rows):
    assert by_id((r.doc_id, r.n_words) for r in o5.token_counts(docs, PIECES).collect()) == by_id((i, len((t or "").split())) for i, t in rows)


def brute_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    wins, cov = {}, set()
    for k in range(len(w) - 4):
        wins.setdefault(tuple(w[k : k + 5]), []).append(k)
    for at in wins.values():
        if len(at) > 1:
            cov.update(p + d for p in at for d in range(5))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov)


def test_statistics_match_brute_force(spark, docs, rows):
    more = [(300, "a b c d e a b c d e f"), (301, "x\nx\n \n\nx y\nx"), (302, "z " * 30), (303, "# $5 a|b <c>\nq"), (304, "é ü\n" * 6)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = o8.statistics(both).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert by_id(map(tuple, got)) == by_id((i, *brute_statistics(t)) for i, t in rows + more)


def test_rules_separate_and_stay_native(spark):
    rng = random.Random(8)
    rows = [(k, sentence(rng, 40) if k % 4 else " ".join(f"{w}$$" for w in sentence(rng, 40).split())) for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = o8.quality_rules(d, d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1).alias("quality")))
    assert out.where((F.col("doc_id") % 4 == 0) == F.col("kept")).count() == 0
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def brute_rules(rows, edges):
    """Sequential covering by trying every threshold on every row; rows: (statistics, bad, grow)."""
    rules, left = [], list(rows)
    over = lambda x, t: (x[0][t[0]] > t[2]) == (t[1] == ">")
    tally = lambda xs, grow: (sum(x[1] for x in xs if x[2] == grow), sum(not x[1] for x in xs if x[2] == grow))
    while True:
        terms, steps, now = [], [], left
        b0, g0 = tally(now, True)
        while g0 and (terms or b0 >= o8.MIN_COVER):
            tries = [(f, op, t) for f, ts in enumerate(edges) for t in ts for op in (">", "<=")]
            best = max(tries, key=lambda t: o8._gain(*tally([x for x in now if over(x, t)], True), b0, g0))
            kept = [x for x in now if over(x, best)]
            b, g = tally(kept, True)
            if o8._gain(b, g, b0, g0) <= 0 or b < o8.MIN_COVER:
                break
            terms, now, (b0, g0) = [*terms, best], kept, (b, g)
            steps.append((b, g, *tally(kept, False)))
        if not terms:
            return rules
        worth = [(b - g) / (b + g) if b + g else -1.0 for _, _, b, g in steps]
        n = worth.index(max(worth))
        bad, good = steps[n][0] + steps[n][2], steps[n][1] + steps[n][3]
        if bad / (bad + good) < o8.MIN_PRECISION:
            return rules
        rules.append(([(o8.FEATURES[f], op, t) for f, op, t in terms[: n + 1]], bad / (bad + good)))
        left = [x for x in left if not all(over(x, t) for t in terms[: n + 1])]


def test_rule_learning_matches_a_naive_search(spark):
    rng = random.Random(14)
    rows = []
    for k in range(700):
        x = [float(rng.randrange(12)) for _ in o8.FEATURES]
        bad = x[0] > 8 and x[2] <= 6 or x[4] > 10 or rng.random() < 0.05
        rows.append((x, bad, k % 3 != 0))
    d = spark.createDataFrame([(*x, b, g) for x, b, g in rows], ", ".join(f"{f} double" for f in o8.FEATURES) + ", bad boolean, grow boolean")
    rules = o8.learn(d)
    assert len(rules) >= 2 and any(len(t) > 1 for t, _ in rules) and rules == brute_rules(rows, o8.thresholds(d))


def test_folding_and_exceptions():
    assert o10.fold("Ѕtup1d 1d10t cl0wn5 $cum") == ["stupid", "idiot", "clowns", "scum"]
    x = o10.Lexicon({"trash ": 3.0, "lowei": 2.0}, ("trash can",))
    hits = lambda t: x.features(o10.fold(t))[2]
    assert hits("the trash can") == 0 and hits("you TR4SH") == 1 and hits("loweisp und") == 1 and hits("slowei") == 0 and hits("trash can trash") == 1


def test_single_letters_fold_as_whole_texts_do():
    odd = "\U0001f600"  # sends the text the long way
    for c in map(chr, range(0x80, 0x3000)):
        t = f"a{c}b {c}1d"
        assert o10.fold(t) == o10.fold(f"{t} {odd}")


def brute_features(lexicon, text):
    """Every term and phrase tried at every place."""
    t = f" {' '.join(o10.fold(text))} "
    gone = {k for p in lexicon.exceptions for s in range(len(t)) if t.startswith(f" {p} ", s) for k in range(s, s + len(p) + 1)}
    best = {s: max([w for term, w in lexicon.weights.items() if t.startswith(" " + term, s)], default=0) for s in range(len(t))}
    hits = [w for s, w in best.items() if w and s not in gone]
    return sum(hits), len(hits)


def test_lexicon_matches_a_naive_scan():
    rng = random.Random(12)
    x = o10.Lexicon({"trash ": 3.0, "tras": 1.0, "idiot ": 2.0, "can ": 0.5, "fool": 1.5}, ("trash can", "can can", "an idiot", "idiot fool"))
    for _ in range(400):
        t = " ".join(rng.choice(["trash", "can", "an", "idiot", "fool", "fools", "trasher", "Ca\u0301n", "1d10t", "x"]) for _ in range(rng.randrange(0, 12)))
        total, rate, hits = x.features(o10.fold(t))
        want = brute_features(x, t)
        assert hits == want[1] and abs(np.expm1(total) - want[0]) < 1e-9
    long = ["trash", "can"] * 100_000  # a scan of every phrase for every hit would not end
    assert x.found(long) == {} and len(x.found(["trash", "x"] * 100_000)) == 100_000


def test_counts_and_learned_exceptions(spark):
    rng = random.Random(10)
    rows = []
    for k in range(900):
        extra = "you filth " if k % 3 == 0 else "clean filth removal " if k % 12 == 1 else ""
        rows.append((k, f"{sentence(rng, 20)} {extra}{sentence(rng, 5)}", int(k % 3 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, y int")
    got = {r.term: (r.docs, r.toxic) for r in o10.counted(o10.folded(d), o10.terms_of).collect()}
    want = {}
    for _, t, y in rows:
        for term in o10.terms_of(o10.fold(t)):
            n, m = want.get(term, (0, 0))
            want[term] = (n + 1, m + y)
    assert got == want
    lexicon = o10.learn(d.select("doc_id", "text"), d.select("doc_id", F.col("y").alias("toxic")))
    assert {"clean filth", "filth removal"} <= set(lexicon.exceptions) and not any(p in lexicon.exceptions for p in ("you filth",))
    assert lexicon.features(o10.fold("clean F1LTH removal"))[2] == 0 and lexicon.features(o10.fold("some f1lth"))[2] == 1


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(9)
    rows = [(k, sentence(rng, 30) + (" idiot " if k % 4 == 0 else f" zorba{rng.choice('abcdef')}x " if k % 4 == 1 else "") + sentence(rng, 5), int(k % 4 < 2)) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = o10.score_toxicity(d, d.select("doc_id", "toxic")).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 < 2) for r in got if r.held_out]) > 0.97


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <a href=/>home</a></header><nav><ul><li><a href=a>Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div><article><h1>The &amp; title</h1><p>First <b>bold</b> par&#97;graph.<p>Second one,<br>two lines.<div class="ad">Buy now</div>
<script>var x = "</p>";</script><ul><li>an item</li></ul></article><aside>Side story about things.</aside><form><label>Name</label></form><div id="comments"><p>Great post, thanks a lot!</p></div><footer>&copy; 2020</footer>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, "v", None), (None, None, ""), (4, "w", "<p>unclosed <b>page"), (4, "w", "just words.")]
    got = {(r.page_id, r.text, r.n_chars) for r in o3.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()}
    text = "The & title First bold paragraph. Second one, two lines. an item"
    assert got == {(1, text, len(text)), (2, "", 0), (None, "", 0), (4, "unclosed page", 13), (4, "just words.", 11)}


def made_page(rng):
    """A page and its main text, both from a list of parts."""
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    esc = lambda t: t.replace("&", rng.choice(["&amp;", "&#38;", "&#x26;"])).replace("é", rng.choice(["é", "&eacute;", "&#0233;"]))
    junk = lambda: rng.choice([
        f"<nav><ul><li><a href='/x?a=1>2'>{words(2)}</a><li><a href=y>{words(1)}</a></ul></nav>", f'<div class="sidebar {words(1)}"><p>{words(12)}.</p></div>', f"<aside><div><p>{words(30)}.</div></aside>",
        f"<script>if (a<b) {{ document.write('<p>{words(9)}.</p>') }}</script>", f"<!-- <p>{words(9)}.</p> -->", f"<form action=/s><label>{words(3)}</label><input value='{words(2)}'><button>{words(1)}</button></form>",
        f'<div style="display:none"><p>{words(20)}.</p></div>', f'<section id="comments"><p>{words(15)}, {words(4)}.</p><div>{words(9)}!</div></section>', f'<div role=dialog hidden>{words(8)}.</div>', f"<style>p > b {{ content: '<p>' }}</style>",
    ])
    out, text = [], []
    for _ in range(rng.randrange(1, 8)):
        a, b, c = f"{words(rng.randrange(6, 40))}, é & {words(3)}", words(rng.randrange(1, 5)), f"{words(rng.randrange(4, 30))}."
        kind = rng.randrange(5)
        if kind == 0:
            out.append(f"<p>{esc(a)} <b>{b}</b>\n\t{c}{rng.choice(['</p>', ''])}")
        elif kind == 1:
            out.append(f"<blockquote><p>{esc(a)} <a href='/q' title='x > y'>{b}</a> {c}</blockquote>")
        elif kind == 2:
            out.append(f"<ul><li>{esc(a)} <i>{b}</i> {c}<li>{esc(c)}</ul>")
            c = f"{c} {c}"
        elif kind == 3:
            out.append(f"<p>{esc(a)} <span class='ad'>{words(2)}</span>{b} {c}</p>")
        else:
            out.append(f"<table><tr><td>{esc(a)}</td><td>{b} {c}<tr></table>")
        text.append(f"{a} {b} {c}")
        if rng.random() < 0.5:
            out.append(junk())
    body = rng.choice(["<article>{}</article>", "<main><div class=post>{}</div></main>", "<div id=content class='has-sidebar'>{}</div>"]).format("".join(out))
    extra = lambda: "".join(junk() for _ in range(rng.randrange(3)))
    return f"<!DOCTYPE html><html><head><title>{words(4)}</title></head><body class='menu-open'>{extra()}<header><h2>{words(2)}</h2></header>{body}{extra()}<footer>&copy; {words(5)}.</footer></body></html>", " ".join(text)


def test_generated_pages_give_their_main_text():
    rng = random.Random(21)
    for _ in range(500):
        page, text = made_page(rng)
        assert o3.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<a " * 700_000, "<b>" * 300_000 + "</i>" * 300_000, "<b>" * 300_000 + "<p></p>" * 150_000, '<a ">" ' * 300_000, "<a '\"' " * 300_000, '<a b="' * 300_001, "<svg>" * 300_000, "<!--" * 500_000, "<" * 2_000_000, "<!" * 900_000,
    "<blockquote>" * 100_000 + "<p></p>" * 100_000, "<b><div>" * 100_000 + "</b>" * 200_000, "<a x" + " " * 2_000_000 + "y>", "<li>" * 300_000 + "</ul>" * 200_000, "x &#" + "9" * 1_000_000 + "; y", "<p>a few words, and more" * 60_000, "<p>a" * 60_000, "<tr><td>a<tr>" * 80_000,
])
def test_hostile_pages_are_read_in_linear_time(page):
    began = time.process_time()
    o3.main_text(f"<article><p>The text, that comes first.</p></article>{page}")
    assert time.process_time() - began < 20


def test_min_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(60):
        n = rng.randrange(1, 8)
        costs = [rng.randrange(-9, 10) for _ in range(n)]
        edges = [(i, j, rng.randrange(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        price = lambda lab: sum(max(c, 0) for c, x in zip(costs, lab) if not x) + sum(max(-c, 0) for c, x in zip(costs, lab) if x) + sum(w for i, j, w in edges if lab[i] != lab[j])
        assert price(o3.min_cut(costs, edges)) == min(price([b >> k & 1 for k in range(n)]) for b in range(2**n))


@pytest.mark.parametrize("mark", ['span class="ad"', "span hidden", 'a class="share" href="/s"'])
def test_text_after_an_inline_notice_stays(mark):
    page = f"<div><p>Intro words come first here <{mark}>Buy</{mark.split()[0]}> and the rest of the sentence, too.</p></div>"
    assert o3.main_text(page) == "Intro words come first here and the rest of the sentence, too."


@pytest.mark.parametrize("mark", ['div class="has-sidebar"', 'body class="ad"', 'h2 id="related-work"', 'section id="social-impact"', 'div style="overflow:hidden"', 'div title="a hidden thing"'])
def test_loose_names_and_values_hide_nothing(mark):
    tag = mark.split()[0]
    text = "The long enough text, with signs, of an article that nobody wants to lose."
    assert o3.main_text(f"<{mark}>{text}</{tag}>") == text


@pytest.mark.parametrize("mark", ['div class="x ad"', 'div id="cookie-notice"', "div hidden", 'div style="display: none"'])
def test_marked_containers_stay_out(mark):
    assert o3.main_text(f"<p>The long enough text, of an article that stays.</p><{mark}>Some other text, long enough too, to be kept otherwise.</div>") == "The long enough text, of an article that stays."


LONG = "The long enough text, with signs, of an article that nobody wants to lose."


@pytest.mark.parametrize("page", [
    "<body><form id='aspnetForm'><nav><a href=/>Home</a></nav><article><p>{}</p></article></form></body>", "<div id='page' class='search'><main><p>{}</p></main></div>",
    "<div class='top register'><header>Site name</header><div class=widget><article><p>{}</p></article></div></div>", "<form action=/post><div class=page>" + "<p>{}</p>" * 8 + "</div></form>",
    "<aside class=menu><article><h1>{}</h1></article></aside>",
])
def test_wrappers_of_the_article_hide_nothing(page):
    assert o3.main_text(page.replace("{}", LONG)) == " ".join([LONG] * page.count("{}"))


@pytest.mark.parametrize("junk", [
    "<div>Copyright 2020 Some House. All rights reserved.</div>", "<p>© 2019-2021 The Owners of it</p>", "<div>Ein Verlag, alle Rechte vorbehalten.</div>",
    "<section id=comments><article><p>" + "Readers write more than the writer did, by far. " * 12 + "</p></article></section>", "<aside><article><p>A teaser, of another text.</p></article></aside>",
    "<div hidden><article><p>" + "What nobody is shown, though there is much of it. " * 9 + "</p></article></div>", "<form><p>Your name, and your address, please.</p></form>",
])
def test_what_is_no_article_stays_out(junk):
    assert o3.main_text(f"<article><p>{LONG} {LONG}</p></article>{junk}") == f"{LONG} {LONG}"


def test_formulas_and_nested_notices_inside_sentences():
    assert o3.main_text(f"<p>{LONG} The area is <math><msup><mi>r</mi><mn>2</mn></msup><annotation>r^2</annotation></math> units, as shown here.</p>") == f"{LONG} The area is r2 units, as shown here."
    assert o3.main_text(f"<p>{LONG} One <span class=ad>buy <b class=promo>now</b> today</span> two three.</p>") == f"{LONG} One two three."
    assert o3.main_text(f"<article><p>{LONG} Copyright 1710 was the first of its kind.</p></article>").endswith("first of its kind.")


def test_pages_of_other_makers_keep_their_text():
    """Layouts with names that the operator has no list of, and of wrappers that it has."""
    rng = random.Random(33)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for _ in range(200):
        parts = [f"{words(rng.randrange(25, 60))}, {words(9)}." for _ in range(rng.randrange(4, 9))]
        inner = "".join(f"<div class='blk-{rng.randrange(99)}'><p>{p}</p></div>" for p in parts)
        shell = rng.choice(["<form id=f1 class='{}'>", "<div class='{} x7'>", "<section id='{}'>"]).format(rng.choice(["search", "share", "top", "widget", "banner", "notice", "qq-12"]))
        links = "".join(f"<a href=/{k}>{words(1)}</a> " for k in range(9))
        page = f"<html><body>{shell}<div class=zz>{links}</div><div class=lead>{inner}</div><ul>{''.join(f'<li><a href=/{k}>{words(2)}</a>' for k in range(6))}</ul></{shell[1:].split()[0]}><div>Copyright {rng.randrange(1990, 2024)} {words(2)}. All rights reserved.</div></body></html>"
        assert o3.main_text(page) == " ".join(parts)


@pytest.mark.parametrize("batches", [1, 3])
def test_a_later_call_loses_what_an_earlier_one_holds(spark, rows, batches):
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string").repartition(3)
    named = [r for r in rows if r[0] is not None]
    calls = [[r for r in named if r[0] % 3 == k] for k in range(3)]
    index = o4.FingerprintIndex(spark)
    got, seen = [], []
    try:
        for part in calls:
            got.append({(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in o4.substring_dedup(frame(part), batches, index=index).collect()})
            seen += part
            ids = {i for i, _ in part}
            assert got[-1] == {r for r in brute_removed(seen) if r[0] in ids}
        assert len(index.runs) <= o4.MAX_RUNS + 1
    finally:
        index.drop()
    assert sum(r[2] for part in got[1:] for r in part) > 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("window_run_")]


def test_runs_go_when_a_batch_fails(spark, docs, monkeypatch):
    add = o4.FingerprintIndex.add
    monkeypatch.setattr(o4.FingerprintIndex, "add", lambda self, batch: 1 / 0 if self.runs else add(self, batch))
    with pytest.raises(ZeroDivisionError):
        o4.substring_dedup(docs)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("window_run_")]


def test_rows_that_repeat_a_labelled_id_count_once(spark, monkeypatch):
    rows = [(1, f"the same id again {k % 50}", 1) for k in range(20_000)] + [(k, f"other words {k}", k % 2) for k in range(2, 90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = d.select("doc_id", "quality", F.col("quality").alias("toxic")).distinct()
    sizes, fit, stage_ = [], o1.fit, common.stage
    monkeypatch.setattr(o1, "fit", lambda x, y: sizes.append(len(x)) or fit(x, y))
    monkeypatch.setattr(o10, "stage", lambda df, name: (lambda out: sizes.append(out.count()) or out)(stage_(df, name)))
    o1.fit_quality(d, labels, 100)
    o10.learn(d, labels, 100)
    assert len(sizes) == 2 and max(sizes) <= 89


def test_a_very_common_or_long_item_fills_no_block(spark, docs, rows, monkeypatch):
    long = " ".join(f"w{k}" for k in range(1, 700))
    items = [("same", "a passage of more than ten words that is there very often indeed")] * 3000 + [("long", long), ("short", "two words")]
    monkeypatch.setattr(o7, "PIECE", 60)
    bench = spark.createDataFrame(items, "item_id string, text string")
    pieces = o7._pieces(bench).collect()
    assert len(pieces) == 2 + -(-(699 - 10 + 1) // 51) and max(len(p.text.split()) for p in pieces) == 60
    d = spark.createDataFrame([(1, "x " + " ".join(f"w{k}" for k in range(100, 400)) + " y"), (2, "a passage of more than ten words that is there very often indeed, two words")], "doc_id long, text string")
    want = {1: ([1], [301], ["long"]), 2: ([0], [15], ["same", "short"])}
    for block in (4_000_000, 2000):
        monkeypatch.setattr(o7, "BLOCK_WORDS", block)
        assert {r.doc_id: (r.begins, r.ends, r["items"]) for r in o7.hit_spans(d, bench).collect()} == want


@pytest.mark.parametrize("text", ["tr​ash", "tr­ash", "t⁠r﻿ash", "ᴛʀᴀsʜ", "trаѕһ", "TRɑSH", "𝓽𝓻𝓪𝓼𝓱", "ｔｒａｓｈ", "t̶r̶ash", "tr4sh", "тrash"])
def test_disguised_letters_fold(text):
    assert o10.fold(text) == ["trash"]
