"""Quality rules: a learned decision list over per-document statistics, all in DataFrame expressions.

Statistics, learning and scoring are SQL expressions and aggregates only. The list is learned by sequential
covering: each round grows a conjunction of thresholds that best separates bad from good among the labelled
documents not covered yet, prunes it on documents held aside, and becomes one branch of an ordered CASE. Learning
ends as such lists do: where fewer than MIN_COVER bad documents are left, or the best rule that can be grown is
right less often than MIN_PRECISION.

Each statistic is put into the intervals between its thresholds once. A term of a rule then takes one aggregate
over all labelled rows, counts by (statistic, interval); sums of intervals are the counts of every threshold, both ways.
The driver sees these counts only: a row for each statistic and interval.

Nulls: a null text has no words; rows with a null doc_id are kept and scored. Empty tables give no rows.
Repeated rows are each scored. Labels that are null or lack a document are ignored; of several labels of one
document the smallest counts. Other columns of the input are not used, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage

WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Fewest bad documents that a rule covers while it grows, and least share of bad ones among all that it covers.
MIN_COVER, MIN_PRECISION = 8, 0.7
#: Quantiles of each statistic that serve as thresholds.
QUANTILES = [0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.94, 0.97, 0.99]


def _repeated_positions(pairs: str) -> Column:
    """Positions, in order, of the windows that occur twice or more; pairs: a column of (hash, position) in order."""
    here = lambda i: F.get(pairs, i)["h"]
    return F.sort_array(
        F.transform(F.filter(pairs, lambda p, i: F.coalesce(p["h"] == here(i + 1), F.lit(False)) | ((i > 0) & (p["h"] == here(F.greatest(i - 1, F.lit(0)))))), lambda p: p["i"])
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    one = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")).alias("not_upper"),
        F.length(F.translate("text", "!?", "")).alias("not_marks"),
        F.length(F.translate("text", "|", "")).alias("not_bars"),
        F.length("text").alias("chars"),
        F.size(F.array_distinct("words")).alias("distinct_words"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
        ).alias("hashes"),
    )
    # each step is a column of its own, so that no lambda computes an array again for every element
    paired = one.withColumn(
        "pairs",
        F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("hashes")
    two = paired.withColumn("at", _repeated_positions("pairs")).drop("pairs")
    # a window at p adds the words up to the next window's start, five at most
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get("at", k + 1) - p), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda s, x: s + x,
    )
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return (
        two.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .drop("at")
        .withColumns(
            {
                "mean_word": share("word_chars", "n_words"),
                "symbol_share": share("n_symbols", "word_chars"),
                "dup_line_share": share("n_dup_lines", "n_lines"),
                "repeat_share": share("n_repeat_words", "n_words"),
                "distinct_share": share("distinct_words", "n_words"),
                "upper_share": F.when(F.col("chars") > 0, 1 - F.col("not_upper") / F.col("chars")).otherwise(0.0),
                "mark_share": F.when(F.col("chars") > 0, 1 - F.col("not_marks") / F.col("chars")).otherwise(0.0),
                "bar_share": F.when(F.col("chars") > 0, 1 - F.col("not_bars") / F.col("chars")).otherwise(0.0),
                "line_words": F.when(F.col("n_lines") > 0, F.col("n_words") / F.col("n_lines")).otherwise(0.0),
            }
        )
        .drop("not_upper", "not_marks", "not_bars")
    )


FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share", "bar_share", "line_words"]
Term = tuple[str, str, float]


def condition(terms: list[Term]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f) > t if op == ">" else F.col(f) <= t for f, op, t in terms])


def thresholds(labelled: DataFrame) -> list[list[float]]:
    """Quantile thresholds of each statistic; at most as many as QUANTILES, whatever the data."""
    row = labelled.agg(*[F.percentile_approx(f, QUANTILES, 10_000).alias(f) for f in FEATURES]).first()
    return [sorted(set(row[f] or [])) for f in FEATURES]


def intervals(labelled: DataFrame, edges: list[list[float]]) -> DataFrame:
    """bad, grow and at, an array of the number of thresholds that each statistic exceeds."""
    over = lambda f, ts: sum(((F.col(f) > t).cast("int") for t in ts), F.lit(0))
    return labelled.select("bad", "grow", F.array(*[over(f, ts) for f, ts in zip(FEATURES, edges)]).alias("at"))


def counts(rows: DataFrame, edges: list[list[float]]) -> dict[tuple[int, str, int], list[int]]:
    """For each candidate term (statistic, > or <=, threshold): bad and good of the growing part, bad and good of the pruning part."""
    parts = [F.col("grow") & F.col("bad"), F.col("grow") & ~F.col("bad"), ~F.col("grow") & F.col("bad"), ~F.col("grow") & ~F.col("bad")]
    seen = rows.select("bad", "grow", F.posexplode("at").alias("f", "k")).groupBy("f", "k").agg(*[F.count_if(p).alias(f"n{i}") for i, p in enumerate(parts)]).collect()
    out = {}
    for f, ts in enumerate(edges):
        at = [[0] * 4 for _ in range(len(ts) + 1)]
        for r in seen:
            if r.f == f:
                at[r.k] = [r.n0, r.n1, r.n2, r.n3]
        for t in range(len(ts)):
            out[f, ">", t] = [sum(c) for c in zip(*at[t + 1 :])]
            out[f, "<=", t] = [sum(c) for c in zip(*at[: t + 1])]
    return out


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    from math import log2

    if not bad:
        return 0.0
    return bad * (log2(bad / (bad + good)) - log2(max(bad0, 1) / max(bad0 + good0, 1)))


def learn(labelled: DataFrame) -> list[tuple[list[Term], float]]:
    """Ordered rules (terms, share of bad documents among those covered) from all labelled rows (statistics, bad, grow)."""
    rules: list[tuple[list[Term], float]] = []
    edges = thresholds(labelled)
    left = stage(intervals(labelled, edges), "rule-intervals")
    holds = lambda terms: reduce(lambda x, y: x & y, [F.get("at", F.lit(f)) > t if op == ">" else F.get("at", F.lit(f)) <= t for f, op, t in terms])
    while any(edges):
        terms, steps, rows = [], [], left
        bad0 = good0 = None
        while good0 != 0:
            found = counts(rows, edges)
            if bad0 is None:
                one = next(t for t in found)
                bad0, good0 = (found[one][i] + found[one[0], "<=", one[2]][i] for i in (0, 1))
                if bad0 < MIN_COVER or not good0:
                    break
            gain, k = max((_gain(*n[:2], bad0, good0), -k) for k, n in enumerate(found.values()))
            term, n = list(found.items())[-k]
            if gain <= 0 or n[0] < MIN_COVER:
                break
            terms.append(term)
            steps.append(n)
            bad0, good0 = n[:2]
            rows = left.where(holds(terms))
        if not terms:
            break
        # prune: the ending part that can go without loss of (bad - good) / covered on the part held aside
        n = -max(((b - g) / (b + g) if b + g else -1.0, -n) for n, (_, _, b, g) in enumerate(steps))[1]
        bad, good = steps[n][0] + steps[n][2], steps[n][1] + steps[n][3]
        if bad / (bad + good) < MIN_PRECISION:
            break
        rules.append(([(FEATURES[f], op, edges[f][t]) for f, op, t in terms[: n + 1]], bad / (bad + good)))
        left = left.where(~holds(terms[: n + 1]))
    return rules


def apply_rules(stats: DataFrame, rules: list[tuple[list[Term], float]]) -> DataFrame:
    """rule (its number from 1, null if none holds), bad_share of that rule, base_failed and kept."""
    number, share = F.lit(None).cast("int"), F.lit(0.0)
    for k in range(len(rules), 0, -1):
        terms, precision = rules[k - 1]
        number, share = F.when(condition(terms), F.lit(k)).otherwise(number), F.when(condition(terms), F.lit(precision)).otherwise(share)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        stats.withColumns({"rule": number, "bad_share": share, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document with the verdict of rules learned from its labelled rows (labels: doc_id, quality)."""
    stats = stage(statistics(docs), "rule-stats")
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 0).alias("bad"))
    labelled = stage(
        stats.select("doc_id", *FEATURES).join(marks, "doc_id").withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0), "rule-rows"
    )
    return apply_rules(stats, learn(labelled))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule", "bad_share")
