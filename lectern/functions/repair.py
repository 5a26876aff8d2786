"""Repairs inside one line of text: glued words taken apart, broken lines told from sound ones."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cleaning import join_broken_tokens, split_camel
from .text import col, fold_letters, trim_all

#: Phrases that converters glue together, in the order in which they are taken apart.
GLUED = (
    "giá trị", "định nghĩa", "thông báo", "nhóm câu", "thực hiện", "cơ sở dữ liệu", "được thực", "được đặt", "lưu trữ", "ứng dụng",
    "bắt buộc", "tùy chọn", "tạo thông", "người dùng", "tạo thành", "dữ liệu", "kiểm tra", "xử lý", "trả về", "khai báo",
    "nội dung", "chỉnh sửa", "tham chiếu", "tham số", "câu lệnh", "hợp lệ", "tính hợp", "cơ sở", "điểm lưu", "quản lý",
    "kết quả", "phương pháp", "nguyên tắc", "khả năng", "thành phần", "điều kiện", "yêu cầu", "quá trình", "kế hoạch", "vấn đề",
    "giải pháp", "khái niệm", "ví dụ", "chú ý", "lưu ý", "tổng kết", "tổng quan", "phân tích", "đánh giá", "so sánh",
    "minh hoạ", "minh họa", "trình bày", "mục tiêu", "bài tập", "bài kiểm", "bài giảng", "bài học", "bài toán", "chương trình",
    "học tập", "sinh viên", "giáo viên", "giảng viên", "nhận xét", "kết luận", "thực tế", "thực tiễn", "hệ thống", "phần mềm",
    "phần cứng", "mạng lưới", "máy chủ", "máy khách", "máy tính", "giao thức", "giao dịch", "giao tiếp", "kết nối", "cổng kết",
    "truyền tải", "truyền thông", "nhận dạng", "xác thực", "xác nhận", "bảo mật", "bảo trì", "tối ưu", "hiệu suất", "hiệu năng",
    "tốc độ", "đồng bộ", "đồng thời", "cập nhật", "tải về", "ghi log", "nhật ký", "hợp đồng", "thị trường", "doanh nghiệp",
    "doanh thu", "chi phí", "lợi nhuận", "đầu tư", "ngân sách", "thuế suất", "báo cáo", "tài khoản", "tài sản", "nghĩa vụ",
    "quyền lợi", "quy định", "quy trình", "điều khoản", "pháp lý", "pháp lệnh", "nghiên cứu", "thí nghiệm", "bệnh nhân", "chẩn đoán",
    "điều trị", "triệu chứng", "phòng ngừa", "sức khỏe", "môi trường", "năng lượng", "nhiệt độ", "thông qua", "theo đó", "do đó",
    "vì vậy", "tuy nhiên", "ngoài ra", "đặc biệt", "cụ thể", "chẳng hạn", "ví dụ như", "bao gồm", "liên quan", "liên kết",
    "tương ứng", "tương tự", "hơn nữa", "nói cách", "theo cách",
)
#: Phrases of the list above that are also put in small letters where they stand apart already.
LOWERED = ("khái niệm", "ví dụ")
#: Frequent words and phrases by which a glued token is segmented.
FREQUENT = (
    "thực hiện", "cơ sở dữ liệu", "phương pháp", "điều kiện", "kết quả", "quản lý", "ứng dụng", "hệ thống", "phần mềm", "truyền thông",
    "xác thực", "bảo mật", "giao dịch", "giao tiếp", "giao thức", "kết nối", "tối ưu", "hiệu suất", "hiệu năng", "đồng bộ",
    "cập nhật", "nghiên cứu", "thí nghiệm", "môi trường", "năng lượng", "doanh nghiệp", "hợp đồng", "thị trường", "ngân sách", "báo cáo",
    "quy trình", "quy định", "điều khoản", "pháp lý", "bài học", "bài toán", "chương trình", "sinh viên", "giảng viên", "kết luận",
    "tổng kết", "phân tích", "đánh giá", "so sánh", "lưu trữ", "tham số", "câu lệnh", "thông báo", "người dùng", "dữ liệu",
    "kiểm tra", "xử lý", "trả về", "khai báo", "nội dung", "chỉnh sửa", "tham chiếu", "điểm lưu", "giải pháp", "được",
    "không", "trong", "của", "với", "một", "các", "những", "này", "đó", "về", "từ", "đến", "và", "hay", "hoặc", "nhưng", "khi", "nếu",
    "là", "có", "cho", "theo", "qua", "tại", "vào", "ra", "trên", "dưới", "sau", "trước", "bằng", "giữa", "ngoài", "mỗi", "mọi", "cả",
    "như", "vì", "do", "nên", "thì", "mà", "để", "sẽ", "đã", "đang", "cần", "phải", "muốn", "thể", "bị", "bởi", "giúp", "làm",
    "tạo", "gọi", "dùng", "sử", "dụng", "thực", "hiện", "chạy", "mới", "cũ", "lớn", "nhỏ", "cao", "thấp", "nhanh", "chậm",
    "tốt", "xấu", "đúng", "sai", "hợp", "lệ", "hợp lệ", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín", "mười", "đầu", "cuối",
    "lần", "lượt", "loại", "dạng", "kiểu", "cách", "bước", "giá", "trị", "số", "lượng", "tổng", "phần", "nhóm", "mục",
    "tên", "tệp", "file", "thư", "đường", "dẫn", "người", "hệ", "thống", "máy", "tính", "mạng", "phép", "toán", "hàm", "biến",
    "lệnh", "khối", "vòng", "lặp", "điều", "khiển", "luồng", "tiến", "trình", "lỗi", "ngoại", "cảnh", "báo", "thông",
)
#: Letters that only Vietnamese text has, small ones.
VI_SMALL = "àáảãạâầấẩẫậăằắẳẵặèéẻẽẹêềếểễệđìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵ"
VI = f"[{VI_SMALL}{VI_SMALL.upper()}]"
#: Trimmed lines that say nothing.
GARBAGE = (
    r"^\([0-9]+\)\)\s*[0-9/]+", r"^-\s*['\x22`]\)\s*[0-9\s\-]+$", r"^\)\s*[0-9]+\s*$", r"^\(\s*[0-9]+\s*\)\s*$", r"^[0-9]{1,4}\s*$", r"^[0-9\s,\-–—]+$",
    r"^[.\-_=*~`|]{3,}\s*$", r"^[0-9]{1,2}[.)]\s*$", r"^[^A-Za-z0-9_\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]{1,3}$",
)
#: A link and a stray token behind it (on the next line as well), a link alone on its line, a path behind a short word.
BROKEN_URLS = (r"https?://\S+\s+\S*(?:\.\w+)?", r"(?m)^https?://[^\s]+\s*$", r"(?im)^[a-z]{1,5}\s+[\w/.\-]+\.\w{2,5}\s*$")
#: What a Markdown line begins with, and a numbered heading.
MARKUP = r"^#{1,6}\s|^[-*+•◦]\s|^[0-9]+\.\s|^[|>]|^```"
NUMBERED = r"^[0-9]+(?:\.[0-9]+)+\s+[A-ZÀ-Ỹa-zà-ỹ]"
MARKS = r"[\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def glued_pairs() -> list[tuple[str, str]]:
    """(pattern, phrase) in order."""
    return [pair for p in GLUED for pair in ([(p, p)] if p in LOWERED else []) + [(p.replace(" ", ""), p)]]


def any_of(words: list[str]) -> str:
    """One pattern for many words that looks at a place's first letter before it tries them."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0], []).append(w[1:])
    return f"(?=[{''.join(first)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + ")"


def split_known_glued(c: str | Column) -> Column:
    """Known phrases that are glued together stand apart; texts that hold none are passed by, and of the others each phrase is
    looked for only if the text held it at first: taking phrases apart glues none."""
    pairs, t = glued_pairs(), col(c)
    every = F.array(*[F.struct(F.lit(p).alias("glued"), F.lit(whole).alias("whole"), F.lit(" " in p).alias("apart")) for p, whole in pairs])
    held = let(fold_letters(t), lambda f: F.filter(every, lambda s: s["apart"] | F.contains(f, s["glued"])))
    fold = F.aggregate(held, t, lambda x, s: F.regexp_replace(x, F.concat(F.lit("(?iu)"), s["glued"]), s["whole"]))
    return F.when(F.lower(t).rlike(any_of([p for p, _ in pairs])), fold).otherwise(t)


def segment_pattern() -> str:
    """The longest frequent word at a place, else one character."""
    words = sorted({w.replace(" ", "") for w in FREQUENT}, key=lambda w: (-len(w), w))
    return "|".join([*words, "."])


def split_glued_vi(token: str | Column) -> Column:
    """A token of eight characters or more in frequent words, if at least two of them make up four fifths of it."""
    t = col(token)

    def apart(s: Column) -> Column:
        words = F.filter(s, lambda x: F.length(x) >= 2)
        covered = F.aggregate(words, F.lit(0), lambda n, x: n + F.length(x))
        cut = F.aggregate(
            s,
            F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
            lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), F.concat(a["out"], F.when(a["at"] > 1, " ").otherwise(""), F.substring(t, a["at"], F.length(x))).alias("out")),
        )["out"]
        return F.when((covered >= 0.8 * F.length(t)) & (F.size(words) >= 2), F.trim(F.regexp_replace(cut, r"\s{2,}", " "))).otherwise(t)

    plain = (F.length(t) < 8) | t.rlike("^[A-Z][A-Z0-9_]+$|^[0-9]|^https?://")
    return F.when(plain, t).otherwise(let(F.regexp_extract_all(F.lower(t), F.lit(segment_pattern()), 0), apart))


def fix_glued_line(line: Column) -> Column:
    """Glued words of one line taken apart; fences, tables and comments stay."""

    def token(x: Column) -> Column:
        return F.when(F.length(x) < 8, x).when(x.rlike(VI), split_glued_vi(x)).otherwise(split_camel(x))

    # a line without letters of the one kind and without bounds of the other has no token to change
    some = VI + "|[a-z][A-Z]|[A-Z]{2}[a-z]|[a-zA-Z][0-9]|[0-9][a-zA-Z]"
    fixed = let(split_known_glued(line), lambda y: F.when(y.rlike(some), F.array_join(F.transform(F.split(y, r"\s+"), token), " ")).otherwise(F.regexp_replace(y, r"\s+", " ")))
    fixed = join_broken_tokens(F.regexp_replace(fixed, "([◦•])([A-ZÀ-Ỹa-zà-ỹ])", "$1 $2"))
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(fixed, r"\s{2,}", " "), r" \.", "."), r"\s+$", "")
    return F.when(trim_all(line).rlike(r"^(?:```|\||//|/\*|--)"), line).otherwise(fixed)


def fix_glued_words(c: str | Column) -> Column:
    return F.array_join(F.transform(F.split(col(c), "\n"), fix_glued_line), "\n")


def drop_broken_urls(c: str | Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), BROKEN_URLS, col(c))


def close_up_marks(c: str | Column) -> Column:
    """No space before or behind a combining mark."""
    return F.regexp_replace(F.regexp_replace(col(c), f" ({MARKS})", "$1"), f"({MARKS}) ", "$1")


#: Keywords that lost their first letter, and what they are whole.
TRUNCATED = (
    ("EGIN", "BEGIN"), ("AVE TRAN", "SAVE TRAN"), ("OMMIT", "COMMIT"), ("OLLBACK", "ROLLBACK"), ("ELECT", "SELECT"), ("NSERT", "INSERT"), ("PDATE", "UPDATE"), ("ELETE", "DELETE"),
    ("REATE", "CREATE"), ("ROP ", "DROP "), ("LTER", "ALTER"), ("HERE ", "WHERE "), ("ROM ", "FROM "), ("ROUP BY", "GROUP BY"), ("RDER BY", "ORDER BY"), ("AVING", "HAVING"),
    ("OIN", "JOIN"), ("NNER", "INNER"), ("UTER", "OUTER"), ("IGHT", "RIGHT"), ("EFT", "LEFT"), ("ECLARE", "DECLARE"), ("XEC", "EXEC"), ("RINT", "PRINT"),
    ("F ", "IF "), ("LSE", "ELSE"), ("HILE", "WHILE"), ("ETURN", "RETURN"), ("OT NULL", "NOT NULL"), ("RIMARY", "PRIMARY"), ("OREIGN", "FOREIGN"),
)


def recover_keywords(c: str | Column) -> Column:
    """Keywords whole again where they begin behind white space, a star or a bar and end at a sign of the language."""
    step = lambda x, s: F.regexp_replace(x, rf"(?<=[*| \n\t]){s[0]}(?=[ \t\n\r*|{{(\[]|\z)", s[1])
    return let(col(c), lambda x: reduce(step, TRUNCATED, x))


def break_sentences(c: str | Column) -> Column:
    """A new line behind each sentence that a capital follows, outside tables; lonely numbers and blank lines beyond one go."""
    line = lambda x: F.when(x.startswith("|"), x).otherwise(F.regexp_replace(x, "([.!?]) ([A-ZÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĐĨŨƠƯẠ])", "$1\n$2"))
    text = F.array_join(F.transform(F.split(col(c), "\n"), line), "\n")
    return trim_all(F.regexp_replace(F.regexp_replace(text, r"(?m)^[0-9]+\.\s*$", ""), r"\n{3,}", "\n\n"))


def drop_junk(c: str | Column) -> Column:
    """Replacement characters and nulls go, line ends are newlines, blank lines are one at a time."""
    clean = F.replace(F.replace(F.translate(col(c), "�\u0000", ""), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(clean, r"\n{3,}", "\n\n")


def tidy_line(line: Column) -> Column:
    """Long white space of a plain line becomes two spaces; tables lose what is behind them; other Markdown stays."""
    kept = trim_all(line).rlike(r"^#{1,6}\s|" + NUMBERED) | line.rlike(r"^\s*[-*+]\s|^\s*[0-9]+\.\s")
    plain = F.replace(F.regexp_replace(line, r"\s{3,}", "  "), F.lit("\t"), F.lit("  "))
    return F.when(line.rlike(r"^\s*\|"), F.regexp_replace(line, r"\s+$", "")).when(kept, line).otherwise(F.regexp_replace(plain, r"\s+$", ""))


def looks_broken(line: Column) -> Column:
    """A short line that is neither Markdown, nor a sentence, nor a heading or Vietnamese prose: a cell of a broken table."""
    t = trim_all(line)
    return ~((t == "") | t.rlike(MARKUP) | t.rlike("[.:?!]$") | (F.length(t) > 60) | t.rlike(NUMBERED) | ((F.length(t) > 40) & (F.regexp_count(t, F.lit(VI)) > 3)))
