"""The cleaner over one text at a time, in Python: lines are looked at in order, and what becomes of a word is remembered.

Patterns are those of repair, with the meaning that they have in Spark: classes are ASCII, and a line also ends at \\r, \\x85, \\u2028 and \\u2029.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from . import repair as R
from .cleaning import SPLIT_WORDS
from .text import FOLDED, NAMED

WHITE = " \t\n\x0b\f\r"
#: Ends of lines that are not white space.
ENDS = "\x85\u2028\u2029"
_BOL, _EOL = r"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))(?!\Z)", r"(?:\Z|(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n))"
_END = r"(?:\Z|(?=[\r\x85\u2028\u2029]\Z)|(?=\r\n\Z)|(?<!\r)(?=\n\Z))"
#: Words of which it is remembered what they become; all are forgotten when there are more.
REMEMBERED, LONGEST = 100_000, 64
#: References that the light chain decodes, in order.
LIGHT = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"))


def compiled(pattern: str, only_newlines: bool = False) -> re.Pattern:
    """A pattern of Spark's dialect; only_newlines: for texts in which no line ends otherwise."""
    flags = re.match(r"\(\?([a-z]+)\)", pattern)
    letters = flags[1] if flags else ""
    begin, end = (_BOL, _EOL) if "m" in letters else (r"\A", _END)
    if only_newlines and "m" in letters:
        begin, end = r"^(?!\Z)", "$"
    tokens = re.findall(r"\\.|\[(?:\\.|[^\]])*\]|.", pattern[flags.end() if flags else 0 :], re.S)
    text = "".join({"^": begin, "$": end}.get(t, t) for t in tokens)
    text = re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", text)
    return re.compile(text, (re.U if "u" in letters else re.A) | (re.I if "i" in letters else 0) | (re.M if "m" in letters else 0))


def by_line(pattern: str) -> Callable[[str], str]:
    """A text without the matches of a pattern that begins and ends with lines."""
    plain, any_end = compiled(pattern, True), compiled(pattern)
    return lambda t: (any_end if any(x in t for x in "\r" + ENDS) else plain).sub("", t)


drop_link, drop_link_line, drop_path_line = compiled(R.BROKEN_URLS[0]), by_line(R.BROKEN_URLS[1]), by_line(R.BROKEN_URLS[2])
drop_lonely_numbers = by_line(r"(?m)^[0-9]+\.\s*$")
many_newlines, wide, long_white = compiled(r"\n{3,}"), compiled(r"\s{2,}"), compiled(r"\s{3,}")
mark_behind, mark_before = compiled(f" ({R.MARKS})"), compiled(f"({R.MARKS}) ")
trimmed_behind, trimmed_both = compiled(r"\s+$"), compiled(r"^\s+|\s+$")
garbage = compiled("|".join(f"(?:{p})" for p in R.GARBAGE))
markup, numbered, sentence_end, vietnamese = compiled(R.MARKUP), compiled(R.NUMBERED), compiled("[.:?!]$"), compiled(R.VI)
heading, listed, table_row = compiled(r"^#{1,6}\s|" + R.NUMBERED), compiled(r"^\s*[-*+]\s|^\s*[0-9]+\.\s"), compiled(r"^\s*\|")
separator_row, last_bar = compiled(r"^\|[\s\-:]+(?:\|[\s\-:]+)+\|?\s*$"), compiled(r"\|$")


def nfc(t: str) -> str:
    return t if t.isascii() else unicodedata.normalize("NFC", t)


def trim(t: str) -> str:
    return trimmed_both.sub("", t) if t[-1:] in ENDS and t else t.strip(WHITE)


def trim_behind(t: str) -> str:
    return trimmed_behind.sub("", t) if t[-1:] in ENDS and t else t.rstrip(WHITE)


def single_spaced(t: str) -> bool:
    """Whether a line has no white space but single spaces; some lines are held for others that have."""
    return "  " not in t and t.isprintable()


def blank_lines(t: str) -> str:
    return many_newlines.sub("\n\n", t) if "\n\n\n" in t else t


def decode_entities(t: str) -> str:
    if "&" not in t:
        return t
    for a, b in NAMED:
        t = t.replace(a, b)
    for pattern, base in (("&#([0-9]{1,7});", 10), ("&#x([0-9a-fA-F]{1,6});", 16)):
        for ref, digits in dict.fromkeys((m[0], m[1]) for m in re.finditer(pattern, t)):
            n = int(digits, base)
            if n < 32 and n not in (9, 10, 13):
                t = t.replace(ref, "")
            elif n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF:
                t = t.replace(ref, chr(n))
    return t


def close_up_marks(t: str) -> str:
    return t if t.isascii() else mark_before.sub(r"\1", mark_behind.sub(r"\1", t))


def drop_broken_urls(t: str) -> str:
    if "http" in t:
        t = drop_link_line(drop_link.sub("", t))
    return drop_path_line(t)


def without_junk(t: str) -> str:
    return t.replace("\ufffd", "").replace("\x00", "").replace("\r\n", "\n").replace("\r", "\n")


def unwrap_single_column_tables(lines: list[str]) -> list[str]:
    out: list[str] = []
    at = 0
    while at < len(lines):
        if not lines[at].lstrip(" ").startswith("|"):
            out.append(lines[at])
            at += 1
            continue
        begun, real, inners = at, False, []
        while at < len(lines) and (t := lines[at].strip(" ")).startswith("|"):
            inner = last_bar.sub("", t[1:])
            real = real or bool(separator_row.search(t)) or sum(x.strip(" ") != "" for x in inner.split("|")) >= 2
            inners.append(inner.strip(" "))
            at += 1
        out += lines[begun:at] if real else [x for x in inners if x]
    return out


def fences(lines: list[str]) -> list[bool]:
    """Whether each line is inside a code fence; the fence that begins one is."""
    code, out = False, []
    for line in lines:
        code ^= trim(line).startswith("```")
        out.append(code)
    return out


def looks_broken(line: str) -> bool:
    t = trim(line)
    if t == "" or len(t) > 60 or markup.search(t) or sentence_end.search(t) or numbered.search(t):
        return False
    return not (len(t) > 40 and len(vietnamese.findall(t)) > 3)


def flatten_broken_tables(lines: list[str], least: int = 4) -> list[str]:
    out: list[str] = []
    run: list[str] = []
    for line, code in zip([*lines, ""], [*fences(lines), False]):  # an empty line at the end, which is no cell
        if not code and looks_broken(line):
            run.append(line)
            continue
        out += [" | ".join(map(trim, run))] if len(run) >= least else run
        run = []
        out.append(line)
    return out[:-1]


def tidy_lines(lines: list[str]) -> list[str]:
    out = []
    for line, code in zip(lines, fences(lines)):
        t = trim(line)
        if code or t.startswith("```"):
            pass
        elif table_row.search(line):
            line = trim_behind(line)
        elif not (heading.search(t) or listed.search(line)):
            line = trim_behind(line if single_spaced(line) else long_white.sub("  ", line).replace("\t", "  "))
        out.append(line)
    return out


def defrag_lines(lines: list[str], most: int = 8) -> list[str]:
    out: list[str] = []
    run: list[str] = []
    blanks = 0

    def settle() -> None:
        if run:
            out.append(wide.sub(" ", " ".join(run)))
            run.clear()

    for line, code in zip(lines, fences(lines)):
        t = trim(line)
        if t == "":
            blanks += 1
            if not run:
                out.append("")
            elif blanks == 2:
                settle()
                out.append("")
            continue
        if code or len(t) > most or markup.search(t) or numbered.search(t):
            settle()
            out.append(line)
        else:
            run.append(t)
        blanks = 0
    settle()
    return out


# ---- glued words



def any_case(phrase: str) -> re.Pattern:
    """A phrase in letters of either case, as SQL folds them: the signs for kelvin and a long s count, dotted and dotless capitals do not."""
    return re.compile("".join(x if x == " " else f"[{x}{x.upper()}{FOLDED[x] if x in 'ks' else ''}]" for x in phrase))


_PAIRS = [(any_case(p), p, whole) for p, whole in R.glued_pairs()]
_GLUED = re.compile(R.any_of([p for _, p, _ in _PAIRS if " " not in p]))
#: Letters that other languages hardly have, and the phrases that have none of them.
_SELDOM = re.compile("[" + "".join(sorted({x for _, p, _ in _PAIRS for x in p if ord(x) > 255})) + "]")
_COMMON = [p for _, p, _ in _PAIRS if not _SELDOM.search(p)]
#: Letters of which every phrase has one, but for those that are ASCII.
_LETTERS = re.compile("[" + "".join(sorted({x for _, p, _ in _PAIRS for x in p if not x.isascii()})) + "]")
_ASCII = [p for p in _COMMON if p.isascii()]
_APART = [(any_case(p), p.split(" ")[1]) for p in R.LOWERED]
_BULLET = re.compile("([◦•])([A-ZÀ-Ỹa-zà-ỹ])")
_WORDS = re.compile(f"[{WHITE}]+")
_SEGMENT = re.compile(R.any_of(R.segment_pattern().split("|")[:-1]) + "|[^\n\r\x85\u2028\u2029]")  # the longest of one first letter come first still
_PLAIN, _CAPITALS = compiled("^[A-Z][A-Z0-9_]+$|^[0-9]|^https?://"), compiled("^[A-Z0-9_]+$")
_BOUND = re.compile("[a-z][A-Z]|[A-Z]{2}[a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]")
_CAMEL = [re.compile(p) for p in (r"([a-z])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([a-zA-Z])([0-9])", r"([0-9])([a-zA-Z])")]
_STAYS = compiled(r"^(?:```|\||//|/\*|--)")
_SPLIT = [(sorted(re.split(r"\\s[+*]", p), key=len, reverse=True), compiled(f"(?i)(?<![A-Za-z0-9_]){p}(?![A-Za-z0-9_])"), whole) for p, whole in SPLIT_WORDS]


def fold(t: str) -> str:
    return t.lower().replace("ſ", "s")


def may_hold_phrases(low: str) -> bool:
    if not _LETTERS.search(low):
        return any(p in low for p in _ASCII)
    return bool(_SELDOM.search(low)) or any(p in low for p in _COMMON)


def split_known_glued(t: str) -> str:
    held = fold(t)
    for pattern, glued, whole in _PAIRS:
        if glued in held:
            t = pattern.sub(whole, t)
    return t


def split_glued_vi(t: str) -> str:
    if _PLAIN.search(t):
        return t
    segments = _SEGMENT.findall(t.lower())
    long = [len(x) for x in segments if len(x) >= 2]
    if len(long) < 2 or sum(long) < 0.8 * len(t):
        return t
    at, out = 0, []
    for x in segments:
        out.append(t[at : at + len(x)])
        at += len(x)
    return wide.sub(" ", " ".join(out)).strip(" ")


def split_camel(t: str) -> str:
    if not _BOUND.search(t) or (len(t) <= 10 and _CAPITALS.search(t)):
        return t
    for p in _CAMEL:
        t = p.sub(r"\1 \2", t)
    return t


def split_token(t: str) -> str:
    if len(t) < 8:
        return t
    if t.isascii():
        return t if t.isalpha() and t.islower() else split_camel(t)
    return split_glued_vi(t) if vietnamese.search(t) else split_camel(t)


def split_word(t: str) -> str:
    """What a word without white space becomes: known phrases apart, then each part, then signs of a list."""
    known = split_known_glued(t) if _GLUED.search(fold(t)) else t
    return _BULLET.sub(r"\1 \2", " ".join(map(split_token, known.split(" "))))


class Remembered(dict):
    """What becomes of words; each is worked out once as long as it is remembered."""

    def __init__(self, work: Callable[[str], str]):
        self.work = work

    def __missing__(self, word: str) -> str:
        out = self.work(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


class Words:
    """What becomes of words in lines that may hold phrases or signs of a list, and of long words in other lines."""

    def __init__(self) -> None:
        self.any, self.long = Remembered(split_word), Remembered(split_token)


def fix_glued_line(line: str, words: Words, split: list) -> str:
    if _STAYS.search(trim(line)):
        return line
    low, single = fold(line), single_spaced(line)
    if may_hold_phrases(low) or "•" in line or "◦" in line:
        for pattern, second in _APART:  # phrases that stand apart are put in small letters; no other pattern goes beyond a word
            if second in low and pattern.search(line):
                line = split_known_glued(line)
                break
        fixed = " ".join([words.any[x] for x in (line.split(" ") if single else _WORDS.split(line))])
    else:
        fixed = " ".join([x if len(x) < 8 else words.long[x] for x in (line.split(" ") if single else _WORDS.split(line))])
    for _, pattern, whole in split:
        fixed = pattern.sub(whole, fixed)
    if "  " in fixed:
        fixed = wide.sub(" ", fixed)
    return trim_behind(fixed.replace(" .", "."))


def fix_glued_words(t: str, words: Words) -> str:
    low = t.lower()
    split = [x for x in _SPLIT if all(part in low for part in x[0])]  # words of which the text holds all parts
    return "\n".join([fix_glued_line(line, words, split) for line in t.split("\n")])


# ---- the chains


def clean(text: str | None, words: Words, preserve: bool = False) -> str:
    """All steps in their fixed order; preserve leaves broken tables and fragments as they are."""
    t = drop_broken_urls(_unescaped(nfc(close_up_marks(decode_entities(nfc(text or "")))), "_*[]#|"))
    lines = [x for x in unwrap_single_column_tables(t.split("\n")) if (s := trim(x)) == "" or not garbage.search(s)]
    t = "\n".join(tidy_lines(lines if preserve else flatten_broken_tables(lines)))
    t = without_junk(drop_lonely_numbers(blank_lines(t)))
    if not preserve:
        t = "\n".join(defrag_lines(t.split("\n")))
    return fix_glued_words(trim(blank_lines(t)), words)


def clean_lightly(text: str | None, words: Words) -> str:
    """The light chain, for texts without deep defects."""
    t = nfc(text or "")
    for a, b in LIGHT:
        t = t.replace(a, b)
    t = _unescaped(nfc(close_up_marks(t)), "_*[]")
    t = blank_lines(without_junk(drop_link_line(t) if "http" in t else t))
    return trim(fix_glued_words("\n".join(unwrap_single_column_tables(t.split("\n"))), words))


def _unescaped(t: str, signs: str) -> str:
    if "\\" in t:
        for s in signs:
            t = t.replace("\\" + s, s)
    return t
