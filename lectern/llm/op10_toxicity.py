"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, maps look-alike letters to Latin ones, drops what shows nothing, reads digits and signs between
letters as the letters they stand for, and turns everything else into single spaces. The lexicon holds whole
words and word beginnings whose share of toxic documents, counted over labelled rows, is far above the rest;
the weight is the log odds. Exception phrases that hold a lexicon word are matched by the same automaton and
cancel the hits inside them: some fixed English ones, and learned ones, the pairs of a lexicon word and a
neighbour whose labelled documents are toxic no more often than others. A score is a logistic function of the weight
found and of the weight for each word of the text.

Counting, matching and scoring run inside Spark tasks; counts meet in one aggregate. Learning sees about
max_rows labelled rows, by hash of the id. A term must be in MIN_DOCS toxic ones of them and an exception in
MIN_PHRASE, so that bound also bounds the lexicon and the automaton; neither is cut to a number.

Nulls and empty texts have no hits and get the score of no hits. Null ids are scored, never learned from.
Repeated rows are each scored. Of several labels of one document the largest counts; null labels are ignored.
Without toxic labels every score is near 0. Extra columns are not used, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stage
from .op01_quality_gam import remainder, sampled_marks

MAX_ROWS, MIN_DOCS, MIN_PHRASE, MIN_LOG_ODDS = 60_000, 4, 8, 1.5
#: Letters of other scripts that look like Latin ones (Cyrillic, Greek, others, small capitals), and signs that stand for letters.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏвкмнтԛԝѵѡьгєү" + "αοενικρτυχγωηβζμσς" + "ßıøłđæœɪɡɑɩʟʀꞵʋƅսօոհցѻ" + "ᴀʙᴄᴅᴇꜰɢʜᴊᴋᴍɴᴏᴘꜱᴛᴜᴠᴡʏᴢ",
    "aeopcyxijsdhlbkmhtqwvwbrey" + "aoevikptuxywnbzuss" + "sioldaoigailrbvbuonhgo" + "abcdefghjkmnopstuvwyz",
)
#: Characters that show nothing: zero-width ones, soft hyphens, joiners, direction marks, variation selectors.
UNSEEN = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0100, 0xE01F0)])
STANDS_FOR = dict(zip("013457@$!|", "oieastasil"))
#: Phrases of lexicon words that insult nobody.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "stupid simple", "loser bracket")
#: Signs between letters; then one before two letters at the start of a word, and a digit after two letters at its end.
_INNER = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])")
_OUTER = re.compile(r"(?<![\w@$])[013457@$](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[013457](?!\w)")
_WORD = re.compile(r"[^\W_]+")


def _bare(text: str) -> str:
    """Without accents, look-alike letters as Latin ones."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(UNSEEN)) if not unicodedata.combining(c)).translate(LOOK_ALIKES)


#: Most accented letters are single ones that fold alike wherever they stand; a text with others is folded whole.
_SINGLE = {chr(c): _bare(chr(c)) for c in range(0xC0, 0x250)}
_ACCENTED, _OTHER = re.compile("[À-ɏ]"), re.compile("[^\x00-\x7fÀ-ɏ]")  # what is unseen is among the others


def fold(text: str | None) -> list[str]:
    """The folded words of a text."""
    t = (text or "").lower()
    if not t.isascii():
        t = _bare(t) if _OTHER.search(t) else _ACCENTED.sub(lambda m: _SINGLE[m[0]], t)
    for signs in (_INNER, _OUTER):
        if signs.search(t):
            t = signs.sub(lambda m: "".join(STANDS_FOR[c] for c in m[0]), t)
    return _WORD.findall(t)


def terms_of(words: list[str]) -> set[str]:
    """Whole words (closed by a space) and beginnings of four to six letters."""
    out = set()
    for w in set(words):
        out.add(f"{w} ")
        for n in range(4, min(6, len(w)) + 1):
            out.add(w[:n])
    return out


def folded(rows: DataFrame) -> DataFrame:
    """doc_id, y and words (the folded words, joined by a space) of rows (doc_id, text, y)."""
    small_batches(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(fold(t)) for t in b.column(2).to_pylist()], pa.string())], names=["doc_id", "y", "words"])

    return rows.select("doc_id", "y", "text").mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y {rows.schema['y'].dataType.simpleString()}, words string")


def counted(rows: DataFrame, terms) -> DataFrame:
    """term, docs and toxic over rows (words, y), for the set of terms that the function finds in a list of words; summed in each task first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, toxic = Counter(), Counter()

        def flush():
            keys = list(docs)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([docs[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], names=["term", "docs", "toxic"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = terms(text.split())
                docs.update(found)
                if y:
                    toxic.update(found)
            if len(docs) > 300_000:
                yield flush()
                docs, toxic = Counter(), Counter()
        yield flush()

    return rows.select("words", "y").mapInArrow(work, "term string, docs long, toxic long").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


class Lexicon:
    """Terms with weights, exception phrases, and the logistic function over what they find."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.exceptions, self.coef = weights, exceptions, np.array([-4.0, 1.0, 0.0])
        self._build()

    def _build(self) -> None:
        self.machine = ahocorasick.Automaton()
        for term, w in self.weights.items():
            self.machine.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "coef": self.coef}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._build()

    def found(self, words: list[str]) -> dict[int, float]:
        """The best term's weight at the start of each word that has one, outside exception phrases."""
        if not words or not len(self.machine):
            return {}
        best: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        for end, (size, w) in self.machine.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if w is None:
                spans.append((start, end))
            else:
                best[start] = max(best.get(start, 0.0), w)
        if spans:  # phrases and hits in order of their starts: a hit is excused if a phrase begun so far reaches beyond it
            spans.sort()
            k, reach, out = 0, -1, {}
            for s in sorted(best):
                while k < len(spans) and spans[k][0] <= s:
                    reach, k = max(reach, spans[k][1]), k + 1
                if s >= reach:
                    out[s] = best[s]
            best = out
        return best

    def features(self, words: list[str]) -> tuple[float, float, int]:
        """Weight found, weight for each word (on a log scale), hits: the best term of each word counts once."""
        best = self.found(words)
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 1))), len(best)

    def phrases(self, words: list[str]) -> set[str]:
        """The pairs of each word that has a term with the word before and the word behind it."""
        best, out, at = self.found(words), set(), 0
        for k, w in enumerate(words) if best else ():
            if at in best:
                out |= {f"{a} {b}" for a, b in zip(words[max(k - 1, 0) : k + 1], words[max(k - 1, 0) + 1 : k + 2])}
            at += len(w) + 1
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.coef[0] + x[:, :2] @ self.coef[1:], -30, 30)))


def choose_terms(counts: DataFrame, n_docs: int, n_toxic: int) -> dict[str, float]:
    """The telling terms; a longer term gives way to its own beginning where that tells as much."""
    odds = F.log(((F.col("toxic") + 0.5) * (n_docs - n_toxic + 1.0)) / ((F.col("docs") - F.col("toxic") + 0.5) * (n_toxic + 1.0)))
    p = n_toxic / max(n_docs, 1)
    sure = F.col("toxic") - p * F.col("docs") > 3 * F.sqrt(p * (1 - p) * F.col("docs"))  # no accident of a few documents
    rows = counts.where((F.col("toxic") >= MIN_DOCS) & (2 * F.col("toxic") > F.col("docs")) & sure).withColumn("w", odds).where(F.col("w") >= MIN_LOG_ODDS)
    w = {r.term: float(r.w) for r in rows.orderBy("term").collect()}
    return {t: v for t, v in w.items() if not any(t[:n] in w and w[t[:n]] >= 0.8 * v for n in range(4, len(t)))}


def choose_phrases(counts: DataFrame, n_docs: int, n_toxic: int) -> tuple[str, ...]:
    """Pairs with a lexicon word that are in MIN_PHRASE documents, of which no larger share is toxic than of all."""
    rows = counts.where((F.col("docs") >= MIN_PHRASE) & (F.col("toxic") * n_docs <= F.col("docs") * n_toxic))
    return tuple(r.term for r in rows.orderBy("term").collect())


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton steps with a small ridge; columns: 1, then x."""
    a = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.05, 0.05])
        c += np.linalg.solve(h, a.T @ (y - p) - np.array([0, 0.05, 0.05]) * c)
    return c


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Lexicon:
    """A lexicon from labelled documents; labels: doc_id, toxic. Their texts are folded once."""
    marks = sampled_marks(labels, "toxic", remainder("doc_id", 3) != 1, max_rows, F.max)
    words = folded(docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id"))
    # rows that repeat an id count as one, so that the bound on ids is one on rows
    one = words.groupBy("doc_id").agg(F.min_by(F.struct("y", "words"), F.struct(F.xxhash64("words"), "words")).alias("r"))
    rows = stage(one.select("doc_id", "r.*"), "toxic-rows")
    n_docs, n_toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = choose_terms(counted(rows, terms_of), n_docs, n_toxic)
    lexicon = Lexicon(weights)
    if weights and n_docs > n_toxic:
        lexicon = Lexicon(weights, EXCEPTIONS + choose_phrases(counted(rows, lexicon.phrases), n_docs, n_toxic))
        seen = lexicon_features(rows, lexicon, "words", "y").toPandas()
        lexicon.coef = logistic(seen[["total", "rate"]].to_numpy(float), seen.y.to_numpy(float))
    return lexicon


def lexicon_features(docs: DataFrame, lexicon: Lexicon, text: str = "text", *more: str) -> DataFrame:
    """doc_id, total, rate and hits of every row, from its text or its folded words, with more columns kept."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", text, *more)
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in more)
    words = str.split if text == "words" else fold

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [lexicon.features(words(t)) for t in b.column(1).to_pylist()]
            cols = [pa.array([x[k] for x in f], kind) for k, kind in enumerate((pa.float64(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *cols], names=["doc_id", *more, "total", "rate", "hits"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{kept}, total double, rate double, hits int")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and hits, for every document."""
    lexicon = learn(docs, labels, max_rows)

    @F.pandas_udf("double")
    def scored(total: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(lexicon.score(np.column_stack([total, rate])))

    return lexicon_features(docs, lexicon).select("doc_id", (F.coalesce(remainder("doc_id", 3), F.lit(-1)) == 1).alias("held_out"), scored("total", "rate").alias("score"), "hits")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "hits")
