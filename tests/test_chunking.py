"""Chunking against plain Python over small documents."""

import random
import re
import time

from pyspark.sql import functions as F

from lectern.operators import chunking as C


def nw(t):
    return len(t.split())


def tail(text, n=2):
    s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text)]
    s = [x for x in s if len(x) > 20]
    return " ".join(s[-n:])


def split_long(heading, lines):
    done, head = [], [heading, ""] if heading else []
    hw = nw(heading or "")
    buf, n, fence, table = list(head), hw, False, False

    def settle(least):
        text = "\n".join(buf).strip()
        k = nw(text)
        if k >= C.MIN_WORDS or (not done and k >= least):
            done.append([text, k])
        elif done and k:
            done[-1][0] += "\n" + text
            done[-1][1] += k

    def flush():
        nonlocal buf, n
        settle(10**6)
        t = tail(done[-1][0]) if done else ""
        buf, n = head + ([t] if t else []), hw + nw(t)

    for line in lines:
        blank, mark = not line.strip(), line.lstrip()
        if mark.startswith("```"):
            fence = not fence
        if blank:
            table = False
        elif not fence and mark.startswith("|"):
            table = True
        free = not fence and not table
        if free and n >= C.MAX_WORDS:
            flush()
            if blank:
                continue
        elif free and blank and n >= C.MIN_WORDS and n > hw:
            flush()
            continue
        buf.append(line)
        n += nw(line)
    settle(C.MIN_NUMBERED)
    return done


def test_long_sections_split_as_a_plain_loop_does(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for d in range(12):
        lines, inside = [], False
        for _ in range(rng.randrange(5, 90)):
            kind = rng.random()
            text = " ".join(rng.choice(["word", "longer-term", "end. Then", "why? Because"]) for _ in range(rng.randrange(1, 30)))
            lines.append("" if kind < 0.12 else "```" if kind < 0.16 else f"| {text} |" if kind < 0.25 else text)
        heading = "## A heading here" if d % 3 else None
        rows.append((d, 0, heading, lines))
        want[d] = split_long(heading, lines)
    got = C.split_long_sections(spark.createDataFrame(rows, "doc_id int, position int, heading string, lines array<string>")).collect()
    have = {d: [] for d in want}
    for r in sorted(got, key=lambda r: (r.doc_id, r.part)):
        have[r.doc_id].append([r.content, r.word_count])
    assert have == want


def windows(text, size, overlap):
    if len(text) <= size:
        return [text]
    out, pos = [], 0
    while pos < len(text):
        if pos + size >= len(text):
            out.append(text[pos:])
            break
        piece = text[pos : pos + size]
        at = piece.rfind("\n\n")
        n = at + 2 if at > size * 0.5 else len(piece)
        out.append(text[pos : pos + n])
        pos += n if len(out) == 1 else max(n - overlap, 1)
    return out


def test_windows_as_a_plain_loop_does(spark):
    rng = random.Random(3)
    texts = ["", "short", "x" * 400, *["".join(rng.choice(["ab", "c d", "\n\n", "e", "\n"]) for _ in range(rng.randrange(50, 900))) for _ in range(20)]]
    got = C.text_windows(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 200, 20).collect()
    for d, t in enumerate(texts):
        assert [r.content for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.window)] == windows(t, 200, 20)


def test_propositions_of_a_section(spark):
    body = "# Title\n```sql\nSELECT nothing here at all now;\n```\n- The `cache` holds e.g. rows that were read before. Short one here.\n1. Version 3.5 of the tool reads many files at once! tiny\nWhat is this"
    got = C.propositions(spark.createDataFrame([(1, 0, "## Caches", body)], "doc_id int, chunk_index int, section string, content string")).collect()
    assert [r.content for r in sorted(got, key=lambda r: r.n)] == ["Caches: The cache holds e.g. rows that were read before", "Caches: Version 3.5 of the tool reads many files at once"]


def test_tables_become_rows(spark):
    page = "<p>x</p><table><tbody><tr><td><p>A</p></td><td><p>B</p></td></tr></tbody></table>"
    got = spark.createDataFrame([(page,)], "html string").select(C.html_tables_to_markdown("html").alias("m")).first().m
    assert got == "<p>x</p>\n\n[BẢNG DỮ LIỆU / SO SÁNH]\n| A | B |\n\n"


def test_short_sections_wait(spark):
    long_body = "\n".join(["word " * 30] * 14)
    doc = "\n".join(["# One", "few words", "# Two", "word " * 60, "# Three", "also few", "# Four", long_body, "# Five", "last words " * 8])
    lines = spark.createDataFrame([(1, doc)], "doc_id int, text string").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    got = [(r.kind, r.content.split("\n")[0]) for r in sorted(C.merge_sections(lines).collect(), key=lambda r: r.position)]
    assert got == [("whole", "# Two"), ("long", "# Four"), ("merged", "# Five")]


def test_long_sections_of_many_lines_are_split_in_one_pass(spark):
    """Forty thousand lines of one section, half of them blank: copying what is done at each line would take hours."""
    lines = [x for k in range(20_000) for x in (f"Line {k} has a few words in it.", "")]
    rows = spark.createDataFrame([(1, 0, "# A", lines), (2, 0, None, ["a\x85", " b \x85"] * 30)], "doc_id int, position int, heading string, lines array<string>")
    began = time.time()
    got = C.split_long_sections(rows).orderBy("doc_id", "part").collect()
    assert time.time() - began < 60
    assert all(r.content.startswith("# A\n") and 40 <= r.word_count < 100 for r in got if r.doc_id == 1) and len(got) > 1000
    assert [r.content for r in got if r.doc_id == 2] == ["\n".join(["a\x85", " b \x85"] * 30)[:-2] + "\x85"]
