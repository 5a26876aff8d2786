"""Document structure, outlines, section merging, duplication between days and coverage of outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import dup_tokens, normalize_space, normalize_text, normalize_vn, words

#: Domains and their keywords.
DOMAINS = [
    ("math", "đạo hàm|tích phân|ma trận|hàm số|phương trình|bất phương trình|hình học|xác suất|thống kê|định lý|chứng minh|số học|đại số|hằng đẳng thức|giới hạn|chuỗi số|vector|tọa độ|tam giác|lượng giác"),
    ("physics", "lực|gia tốc|vận tốc|động lượng|năng lượng|điện trường|từ trường|quang học|nhiệt động lực|cơ học|sóng|dao động|điện tích|điện áp|công suất|entropy|vật lý|newton|einstein"),
    ("chemistry", "nguyên tử|phân tử|ion|axit|bazơ|oxi hóa|khử|phản ứng hóa học|liên kết|hóa hữu cơ|hóa vô cơ|bảng tuần hoàn|mol|dung dịch|nồng độ|đồng phân|este|anken|ankin"),
    ("cs", "thuật toán|độ phức tạp|cấu trúc dữ liệu|lập trình|hàm|vòng lặp|đệ quy|cơ sở dữ liệu|mạng|bộ nhớ|stack|queue|tree|graph|sort|search|api|http|sql|nosql|class|object"),
    ("biology", "tế bào|gen|adn|arn|protein|enzym|quang hợp|hô hấp|tiến hóa|sinh thái|di truyền|nhiễm sắc thể|vi khuẩn|virus|sinh học|cơ thể|mô|cơ quan|hệ thần kinh|miễn dịch"),
    ("medicine", "bệnh|triệu chứng|chẩn đoán|điều trị|thuốc|lâm sàng|giải phẫu|sinh lý|dược lý|phẫu thuật|y khoa|bệnh nhân|liều dùng|tác dụng phụ|kháng sinh|vaccine"),
    ("economics", "gdp|lạm phát|cung cầu|thị trường|giá cả|đầu tư|tín dụng|ngân hàng|tài chính|kinh tế|chi phí|doanh thu|lợi nhuận|thuế|thương mại|xuất nhập khẩu"),
    ("law", "pháp luật|điều luật|quy định|hiến pháp|tội phạm|hợp đồng|trách nhiệm pháp lý|xét xử|luật dân sự|luật hình sự|pháp nhân|nghĩa vụ|quyền lợi|tố tụng|phán quyết|chế tài"),
    ("history", "thế kỷ|triều đại|chiến tranh|cách mạng|lịch sử|đế quốc|thuộc địa|phong trào|sự kiện|nhân vật lịch sử|văn minh|thời kỳ|cuộc kháng chiến|độc lập|thống nhất"),
    ("psychology", "tâm lý|nhận thức|hành vi|cảm xúc|vô thức|phản xạ|động lực|nhân cách|trí nhớ|học tập|rối loạn|liệu pháp|stress|tâm thần|xã hội hóa|bản năng|ý thức"),
    ("engineering", "kỹ thuật|thiết kế|vật liệu|kết cấu|tải trọng|ứng suất|biến dạng|mạch điện|động cơ|nhiệt độ|áp suất|lưu lượng|hệ thống|quy trình sản xuất|chế tạo|cơ khí"),
]


def lines_where(c: str, pattern: str, trimmed: bool = True) -> Column:
    """How many lines match."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: (F.trim(x) if trimmed else x).rlike(pattern)))


def doc_structure(docs: DataFrame, c: str = "text") -> DataFrame:
    """Words, headings, tables, formulas, code blocks, bullets and an estimate of complexity."""
    rows = docs.withColumns(
        {
            "words": F.size(words(c)), "headings": lines_where(c, r"^#{1,4}\s+\S|^[0-9]+(?:\.[0-9]+)+\s+[A-ZÀ-Ỹa-zà-ỹ]"), "_rows": lines_where(c, r"^\|.+\|"),
            "formulas": F.col(c).rlike(r"[∑∏∫√≤≥≈±×÷→←⇒⇔∈∉∩∪∀∃]") | F.col(c).rlike(r"\$[^$]{3,}\$"), "_code": F.regexp_count(c, F.lit("```")) / 2, "bullets": lines_where(c, r"^\s*[-*+•◦]\s", False),
        }
    )
    high = (F.col("words") > 8000) | (F.col("headings") > 20) | (F.col("formulas") & (F.col("_code") > 3))
    medium = (F.col("words") > 3000) | (F.col("headings") > 10) | (F.col("_code") > 5)
    return rows.withColumns(
        {"tables": F.when(F.col("_rows") > 3, F.ceil(F.col("_rows") / 4)).otherwise(0).cast("int"), "code_blocks": F.floor("_code").cast("int"), "complexity": F.when(high, "high").when(medium, "medium").otherwise("low")}
    ).drop("_rows", "_code")


def detect_corruption(c: str = "text") -> Column:
    """Empty table lines, odd characters and runs of tiny lines make a score; two points are corruption."""
    odd = F.regexp_count(c, F.lit(r"[^\x00-\x7FÀ-ɏḀ-ỿ\s]"))
    tiny = F.size(F.filter(F.split(c, "\n"), lambda x: F.length(F.trim(x)).between(1, 2)))
    return F.when(lines_where(c, r"^\|\s*\|$", False) > 5, 2).otherwise(0) + F.when(odd > 50, 1).otherwise(0) + F.when(tiny > 20, 1).otherwise(0) >= 2


def detect_domain(lessons: DataFrame, plans: DataFrame) -> DataFrame:
    """The domain with most keywords in the title, the first 800 characters and the plan's title; the earlier one wins ties."""
    named = lessons.join(plans.select("plan_id", F.col("title").alias("_p")), "plan_id", "left")
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, 800), F.coalesce("_p", F.lit(""))))
    b = "(?:(?<=[a-z0-9_])(?![a-z0-9_])|(?<![a-z0-9_])(?=[a-z0-9_]))"
    counts = F.array(*[F.struct(F.regexp_count(text, F.lit(f"{b}(?:{p}){b}")).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, p) in enumerate(DOMAINS)])
    rows = named.withColumn("_b", F.array_max(counts))
    return rows.withColumn("domain", F.when(F.col("_b.n") > 0, F.col("_b.d")).otherwise("general")).drop("_b", "_p")


def outline(docs: DataFrame, most: int = 40) -> DataFrame:
    """Distinct headings in order: Markdown, numbered lines, chapter words; so many at most."""
    md, num, word = r"^#{1,3}\s+(.+)", r"^([0-9]+(?:\.[0-9]+)*)\s+(.{3,80})", r"(?iu)^(?:chương|chapter|phần|section)\s+"
    head = lambda x: (
        F.when(x.rlike(md), F.substring(F.regexp_replace(F.regexp_extract(x, md, 1), "[*_`]", ""), 1, 100))
        .when(x.rlike(num), F.substring(F.concat_ws(" ", F.regexp_extract(x, num, 1), F.regexp_extract(x, num, 2)), 1, 100)).when(x.rlike(word), F.substring(x, 1, 100))
    )
    found = F.array_compact(F.transform(F.split("text", "\r?\n"), lambda x: head(F.trim(x))))
    return docs.select("doc_id", F.slice(F.array_distinct(found), 1, most).alias("outline"))


def distribute_sections(outlines: DataFrame, days: int) -> DataFrame:
    """Headings dealt to days in blocks of equal size, in order."""
    size = F.ceil(F.size("outline") / days)
    rows = outlines.select("doc_id", size.alias("s"), F.posexplode("outline").alias("i", "section"))
    return rows.select("doc_id", "i", "section", (F.least(F.floor(F.col("i") / F.col("s")), F.lit(days - 1)) + 1).cast("int").alias("day"))


def fallback_plan(docs: DataFrame, days: int) -> DataFrame:
    """An objective for each day: distinct sentences of the first 1500 characters, taken round and round."""
    clean = F.substring(normalize_space("text"), 1, 1500)
    parts = F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(clean, r"([.!?])\s+", "$1\n"), "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 20))
    rows = docs.select("doc_id", parts.alias("p")).select("doc_id", "p", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("day"))
    pick = F.when(F.size("p") > 0, F.get("p", (F.col("day") - 1) % F.size("p"))).otherwise(F.lit("Nắm vững nội dung cốt lõi"))
    return rows.select("doc_id", "day", F.substring(pick, 1, 140).alias("objective"))


def repair_coverage(outlines: DataFrame, covered: DataFrame, days: int) -> DataFrame:
    """Headings that no day covers, dealt one by one from the last day backwards. covered: doc_id, section."""
    key = lambda c: F.substring(normalize_vn(c), 1, 30)
    rows = outlines.select("doc_id", F.posexplode("outline").alias("i", "section")).withColumn("k", key("section")).where(F.length("k") > 4)
    left = rows.join(covered.select("doc_id", normalize_vn("section").alias("k")), ["doc_id", "k"], "left_anti")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("i")) - 1
    return left.select("doc_id", "section", (days - n % days).cast("int").alias("day"))


def content_duplication(lessons: DataFrame, least: float = 0.35) -> DataFrame:
    """Pairs of days of a plan whose text overlaps with an earlier day's title: token sets met through an inverted index,
    never day against day."""
    new = lessons.select("plan_id", F.col("day_number").alias("day"), F.array_distinct(dup_tokens(F.substring("content", 1, 1000))).alias("t"))
    old = lessons.select("plan_id", F.col("day_number").alias("earlier"), F.array_distinct(dup_tokens("title")).alias("t"))
    a = new.select("plan_id", "day", F.size("t").alias("na"), F.explode("t").alias("w"))
    b = old.select("plan_id", "earlier", F.size("t").alias("nb"), F.explode("t").alias("w"))
    shared = a.join(b, ["plan_id", "w"]).where("earlier < day").groupBy("plan_id", "day", "earlier", "na", "nb").agg(F.count("*").alias("n"))
    ratio = F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))
    severity = F.when(ratio > 0.65, "high").when(ratio > 0.5, "medium").otherwise("low")
    return shared.where(ratio > least).select("plan_id", "day", "earlier", F.round(ratio, 6).alias("ratio"), severity.alias("severity"))


def scope_compliance(lessons: DataFrame, repeats: int = 2, least: int = 3) -> DataFrame:
    """Days that repeat an earlier day's title: three of its long words at least twice each in the text. Shorter words of a text can meet
    none, so they are dropped before they are counted."""
    words = lambda c: F.filter(F.split(normalize_text(c), " "), lambda x: F.length(x) > 4)
    title = lessons.select("plan_id", F.col("day_number").alias("earlier"), F.explode(words("title")).alias("w"))
    text = lessons.select("plan_id", F.col("day_number").alias("day"), F.explode(words("content")).alias("w")).groupBy("plan_id", "day", "w").agg(F.count("*").alias("n"))
    hits = text.where(F.col("n") >= repeats).join(title, ["plan_id", "w"]).where("earlier < day").groupBy("plan_id", "day", "earlier").agg(F.count("*").alias("hits"))
    return hits.where(F.col("hits") >= least)


def unwrap_single_column_tables(lines: DataFrame) -> DataFrame:
    """Lines with the bars of one-column table blocks removed; a block with a separator row or two filled cells stays.
    lines: doc_id, i, line."""
    order = W.partitionBy("doc_id").orderBy("i")
    t = F.trim("line")
    inner = F.regexp_replace(F.regexp_replace(t, r"^\|", ""), r"\|$", "")
    cells = F.size(F.filter(F.split(inner, r"\|"), lambda x: F.trim(x) != ""))
    rows = lines.withColumns({"bar": t.startswith("|"), "keep": t.rlike(r"^\|[\s\-:]+(?:\|[\s\-:]+)+\|?\s*$") | (cells >= 2), "inner": F.trim(inner)})
    rows = rows.withColumn("new", F.coalesce((F.col("bar") != F.lag("bar").over(order)).cast("int"), F.lit(1)))
    rows = rows.withColumn("block", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    real = F.max(F.col("keep").cast("int")).over(W.partitionBy("doc_id", "block")) == 1
    return rows.select("doc_id", "i", F.when(~F.col("bar") | real, F.col("line")).when(F.col("inner") != "", F.col("inner")).alias("line")).where("line is not null")


def clone_lessons(lessons: DataFrame, targets: DataFrame) -> DataFrame:
    """Copies of lessons for target plans (lesson_id, plan_id, day_number): status by day, next version, source kept."""
    src = lessons.select("lesson_id", "title", "content", "version")
    version = F.concat(F.lit("v"), (F.coalesce(F.nullif(F.regexp_extract("version", "v([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1)) + 1).cast("string"))
    status = F.when(F.col("day_number") == 1, "in-progress").otherwise("locked")
    return targets.join(src, "lesson_id").select(F.col("lesson_id").alias("reused_from"), "plan_id", "day_number", "title", version.alias("version"), status.alias("status"))
