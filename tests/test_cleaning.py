"""The text cleaner against line-by-line versions and literal cases."""

import random
import re

import pytest

from lectern.functions import repair as R
from lectern.functions import text as X
from lectern.operators import cleaner as C


def one(spark, f, *texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [r[1] for r in sorted(rows.select("doc_id", f("text")).collect())]


def test_glued_words(spark):
    got = one(
        spark, R.fix_glued_words, "Khaibáo dữliệu", "StoredProcedure SQLServer2019x HTTP_CODE", "đượcthựchiệntrong", "| giátrị |", "// giátrị", "  func tion  a .", "◦Nộidung •abc", "abcđượcxyzwq", "a\n```\ngiátrị\n```", "",
    )
    assert got == [
        "khai báo dữ liệu", "Stored Procedure SQLServer 2019 x HTTP_CODE".replace("SQLServer", "SQL Server"), "được thực hiện trong", "| giátrị |", "// giátrị", " function a.", "◦ nội dung • abc", "abcđượcxyzwq", "a\n```\ngiá trị\n```", "",
    ]


def test_entities(spark):
    got = one(spark, X.decode_entities, "&amp;lt; &nbsp;&quot;&apos; &ndash; &#65;&#x42;&#X43; &#7;&#10;. &#9999999; &#55296;", "&amp;#65;")
    assert got == ["&lt;  \"' &ndash; AB&#X43; \n. &#9999999; &#55296;", "A"]


def test_broken_links_and_marks(spark):
    assert one(spark, R.drop_broken_urls, "see https://a.b/c d.e f\nabc path/x.py\nhttps://x.y\nfine line.\nhttps://x.y") == ["see  f\n\n line.\n"]
    assert one(spark, R.close_up_marks, "e \u0301 a") == ["e\u0301a"]


def lines(text):
    return text.split("\n")


def brute_flatten(text):
    out, run, code = [], [], False

    def settle():
        out.extend([" | ".join(x.strip() for x in run)] if len(run) >= 4 else run)
        run.clear()

    for line in lines(text):
        t = line.strip()
        code ^= t.startswith("```")
        sound = code or not t or re.search(r"^#{1,6}\s|^[-*+•◦]\s|^\d+\.\s|^[|>]|^```|[.:?!]$", t) or len(t) > 60 or re.match(r"\d+(\.\d+)+\s+[A-ZÀ-Ỹa-zà-ỹ]", t) or (len(t) > 40 and len(re.findall(R.VI, t)) > 3)
        if sound:
            settle()
            out.append(line)
        else:
            run.append(line)
    settle()
    return "\n".join(out)


def brute_defrag(text):
    out, held, blanks, code = [], [], 0, False

    def settle():
        if held:
            out.append(re.sub(r"\s{2,}", " ", " ".join(held)))
            held.clear()

    for line in lines(text):
        t = line.strip()
        code ^= t.startswith("```")
        if not t:
            blanks += 1
            if blanks >= 2:
                settle()
            if not held:
                out.append("")
            continue
        blanks = 0
        if code or len(t) > 8 or re.search(r"^#{1,6}\s|^[-*+•◦]\s|^\d+\.\s|^[|>]|^```", t) or re.match(r"\d+(\.\d+)+\s+[A-ZÀ-Ỹa-zà-ỹ]", t):
            settle()
            out.append(line)
        else:
            held.append(t)
    settle()
    return "\n".join(out)


@pytest.mark.parametrize("step,brute", [(C.flatten_broken_tables, brute_flatten), (C.defrag_lines, brute_defrag)])
def test_runs_of_lines(spark, step, brute):
    rng = random.Random(3)
    parts = ["", "", " ", "a", "b c", " word ", "12", "# head", "- item", "1. one", "1.2 Part", "```", "| x |", "a longer line", "the end.", "a line of more than eight", "ợợợợ " * 10, "x" * 70]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in C.text_of(docs, step(C.lines_of(docs))).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_whole_chain(spark):
    text = "Cơsởdữliệu &amp; x\n| one column only |\n(5)\n\n\n\nab\ncd\nef\n\nA   sentence   that is\tlong."
    docs = spark.createDataFrame([(1, text, ["glued_words"]), (2, text, []), (3, None, None), (4, "7\n8", ["slide_pdf_wrap"])], "doc_id long, text string, issues array<string>")
    whole = {r.doc_id: r.text for r in C.clean_corpus(docs).collect()}
    kept = {r.doc_id: r.text for r in C.clean_corpus(docs, preserve=True).collect()}
    light = {r.doc_id: r.text for r in C.light_clean(docs).collect()}
    assert whole[1] == "cơ sở dữ liệu & x\none column only\n\nab cd ef\nA sentence that is long."
    assert kept[1] == whole[1].replace("ab cd ef", "ab\ncd\nef\n") and whole[3] == whole[4] == light[3] == ""
    assert light[1] == whole[1] and light[2].startswith("cơ sở dữ liệu & x\none column only\n(5)\n\nab\ncd")


def test_only_phrases_that_a_text_holds_are_taken_apart(spark):
    from pyspark.sql import functions as F

    from lectern.functions import repair as R

    df = spark.createDataFrame([("x Thựchiện VÍ DỤ quátrìnhvídụ y",), ("KHÁINIỆM",), ("none",), (None,)], "t string").select(R.split_known_glued("t").alias("t"))
    assert [r.t for r in df.collect()] == ["x thực hiện ví dụ quá trìnhví dụ y", "khái niệm", "none", None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 5


def test_fragments_are_joined_without_a_second_pass(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a long line of text", "ab", "", "c  d", "", "", "another  long line"])], "doc_id long, i int, line string")
    out = C.defrag_lines(lines)
    assert [r.line for r in out.orderBy("i").collect()] == ["a long line of text", "ab c d", "", "another  long line"]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_chain_is_one_narrow_pass_that_gives_what_the_repairs_give(spark):
    """The chain moves no lines between tasks; its steps over one text are those over lines as rows, also at ends of lines of every kind."""
    from pyspark.sql import functions as F

    from lectern.functions import onetext as T
    from lectern.operators import documents as D

    rng = random.Random(5)
    parts = [
        "\n", "\n", "\n", "\n\n\n", " ", "   ", "\t", "\r", "\r\n", "\x85", "\u2028", "a", "b c", "12", "12.", "(5)", "# head", "1.2 Part", "```", "| x |", "|---|---|", "| a | b |", "•Ab", " .", "&#65;", "&amp;lt;", "e\u0301 ", "\ufffd",
        "https://x.y z", "abc path/x.py", "StoredProcedure", "HTTP_CODE", "đượcthựchiệntrong", "sosánh", "GhiLog", "VÍ DỤ", "khái niệm", "quátrìnhvídụ", "err or", "in for ma tion", "a line of more than eight", "the end.", "ợợợợ " * 10,
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = T.Words()
    over = lambda f: [f(t) for t in texts]
    of_lines = lambda f: over(lambda t: "\n".join(f(t.split("\n"))))
    for step, brute in ((C.flatten_broken_tables, T.flatten_broken_tables), (C.tidy_lines, T.tidy_lines), (C.defrag_lines, T.defrag_lines), (D.unwrap_single_column_tables, T.unwrap_single_column_tables)):
        assert [r.text for r in C.text_of(docs, step(C.lines_of(docs))).orderBy("doc_id").collect()] == of_lines(brute)
    columns = {"entities": X.decode_entities("text"), "marks": R.close_up_marks("text"), "urls": R.drop_broken_urls("text"), "trimmed": X.trim_all("text"), "glued": R.fix_glued_words("text")}
    rows = docs.select("doc_id", *[c.alias(n) for n, c in columns.items()]).orderBy("doc_id").collect()
    for name, brute in (("entities", T.decode_entities), ("marks", T.close_up_marks), ("urls", T.drop_broken_urls), ("trimmed", T.trim), ("glued", lambda t: T.fix_glued_words(t, words))):
        assert [r[name] for r in rows] == over(brute), name
    for out in (C.clean_corpus(docs), C.light_clean(docs.withColumn("issues", F.array(F.lit("glued_words"))))):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_light_chain_keeps_documents_without_an_id_or_with_a_null_issue(spark):
    rows = [(None, "dữliệu", []), (1, "a\nb", []), (1, "c", []), (2, "x", [None]), (3, "ab\ncd", ["glued_words", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, issues array<string>")
    got = sorted((r.doc_id or 0, r.text) for r in C.light_clean(docs).collect())
    assert got == [(0, "dữ liệu"), (1, "a\nb"), (1, "c"), (2, "x"), (3, "ab cd")]


def test_forgotten_words_and_letters_of_other_case_give_the_same(monkeypatch):
    from lectern.functions import onetext as T

    text = "Thựchiện StoredProcedure x\nđượcthựchiệntrong LongerWords2go plainwords\n" * 3
    whole = T.fix_glued_words(text, T.Words())
    monkeypatch.setattr(T, "REMEMBERED", 2)
    monkeypatch.setattr(T, "LONGEST", 9)
    words = T.Words()
    assert T.fix_glued_words(text, words) == whole and len(words.any) <= 2 and len(words.long) <= 2
    # as SQL folds letters: a dotted capital is no i, a long s is an s
    assert T.fix_glued_words("Kháİ nİệm giátrị ſosánh", words) == "Kháİ nİệm giá trị so sánh"
