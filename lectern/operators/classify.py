"""Topic classification of chunks and topic inference for questions by pattern rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_letters, js_regex, may_match

#: Topics and their patterns, in order of precedence; all but the marked ones ignore case.
TOPICS: list[tuple[str, list[str]]] = [
    ("math_statistics", [
        r"\b(đạo\s+hàm|tích\s+phân|giới\s+hạn|xác\s+suất|thống\s+kê|phương\s+sai|độ\s+lệch\s+chuẩn|hồi\s+quy|phương\s+trình|ma\s+trận|đại\s+số|hình\s+học|nhân\s+tử|tích\s+lũy)\b",
        r"\b(derivative|integral|probability|statistics|variance|standard\s+deviation|regression|equation|matrix|algebra|geometry|calculus|hypothesis\s+testing|anova|t-test)\b",
        r"[+\-*/=<>≤≥≈∑∏√∫]",
    ]),
    ("natural_science", [
        r"\b(quang\s+hợp|tế\s+bào|gen|di\s+truyền|phân\s+bào|DNA|RNA|axit|bazơ|hóa\s+trị|phản\s+ứng|nguyên\s+tử|phân\s+tử|lực\s+hấp\s+dẫn|năng\s+lượng|vận\s+tốc|gia\s+tốc|điện\s+từ|quang\s+học|nhiệt\s+động)\b",
        r"\b(photosynthesis|cell|gene|genetic|mitosis|meiosis|molecule|atom|gravitation|velocity|acceleration|electromagnetic|optics|thermodynamics|acid|base|chemical\s+reaction|biology|physics|chemistry)\b",
    ]),
    ("social_science", [
        r"\b(lịch\s+sử|triều\s+đại|cách\s+mạng|chiến\s+tranh|khảo\s+cổ|địa\s+lý|kinh\s+độ|vĩ\s+độ|khí\s+hậu|địa\s+hình|triết\s+học|nhân\s+học|xã\s+hội|ngôn\s+ngữ|văn\s+hóa|pháp\s+luật|chính\s+trị)\b",
        r"\b(history|dynasty|revolution|war|archaeology|geography|latitude|longitude|climate|topography|philosophy|anthropology|sociology|linguistics|culture|politics|constitution)\b",
    ]),
    ("economics_business", [
        r"\b(cung\s+cầu|lạm\s+phát|tài\s+chính|đầu\s+tư|doanh\s+nghiệp|thị\s+trường|cổ\s+phiếu|trái\s+phiếu|lợi\s+nhuận|doanh\s+thu|chi\s+phí|ngân\s+hàng|tiêu\s+dùng|sản\s+xuất|quản\s+trị|chiến\s+lược|quảng\s+cáo)\b",
        r"\b(supply\s+and\s+demand|inflation|finance|investment|enterprise|market|stock|bond|profit|revenue|cost|banking|consumption|production|management|strategy|marketing|advertising|gdp|inflation)\b",
    ]),
    ("stored_procedure", [r"\bCREATE\s+(OR\s+REPLACE\s+)?PROC(EDURE)?\b", r"\bEXEC(UTE)?\s+\w+", r"\bSP_\w+", r"\bPROC(EDURE)?\s+\w+", r"\b@\w+\s+AS\s+\w+"]),
    ("trigger", [r"\bCREATE\s+(OR\s+REPLACE\s+)?TRIGGER\b", r"\bAFTER\s+(INSERT|UPDATE|DELETE)\b", r"\bINSTEAD\s+OF\b", r"\bFOR\s+(INSERT|UPDATE|DELETE)\b"]),
    ("control_flow", [r"\bIF\s+EXISTS\b", r"\bIF\s*\(", r"\bELSE\s+(IF|BEGIN)\b", r"\bWHILE\s*\(", r"\bBEGIN\s*\n", r"\bCASE\s+WHEN\b", r"\bBREAK\b|\bCONTINUE\b|\bGOTO\b|\bRETURN\b"]),
    ("temp_table", [r"\bCREATE\s+TABLE\s+#\w+", r"\bINTO\s+#\w+", r"\b##\w+", r"\bDECLARE\s+@\w+\s+TABLE\b", r"\bSELECT\s+.*\s+INTO\s+#"]),
    ("transaction", [r"\bBEGIN\s+TRAN(SACTION)?\b", r"\bCOMMIT\s+(TRAN(SACTION)?)?\b", r"\bROLLBACK\s+(TRAN(SACTION)?)?\b", r"\bSAVEPOINT\b", r"\b@@TRANCOUNT\b"]),
    ("error_handling", [r"\bBEGIN\s+TRY\b", r"\bBEGIN\s+CATCH\b", r"\bTHROW\b|\bRAISERROR\b", r"\b@@ERROR\b", r"\bERROR_MESSAGE\s*\(\)"]),
    ("cursor", [r"\bDECLARE\s+\w+\s+CURSOR\b", r"\bOPEN\s+\w+\b", r"\bFETCH\s+(NEXT|PRIOR|FIRST|LAST)\b", r"\bCLOSE\s+\w+\b", r"\bDEALLOCATE\b"]),
    ("window_function", [r"\bROW_NUMBER\s*\(\)", r"\bRANK\s*\(\)", r"\bDENSE_RANK\s*\(\)", r"\bNTILE\s*\(", r"\bLEAD\s*\(|\bLAG\s*\(", r"\bFIRST_VALUE\s*\(|\bLAST_VALUE\s*\(", r"\bOVER\s*\(\s*PARTITION\b"]),
    ("date_function", [
        r"\bDATEADD\s*\(", r"\bDATEDIFF\s*\(", r"\bGETDATE\s*\(\)", r"\bSYSDATETIME\s*\(\)", r"\bCURRENT_TIMESTAMP\b", r"\bFORMAT\s*\(.*date", r"\bYEAR\s*\(|\bMONTH\s*\(|\bDAY\s*\(",
        r"\bEOMonth\s*\(", r"\bDATEFROMPARTS\s*\(", r"\bhàm\s+ngày\b|\bhàm\s+thời\s+gian\b", r"\bxử\s+lý\s+ngày\b|\bdữ\s+liệu\s+ngày\b",
    ]),
    ("string_function", [
        r"\bLEN\s*\(|\bLENGTH\s*\(", r"\bSUBSTRING\s*\(", r"\bCHARINDEX\s*\(|\bPATINDEX\s*\(", r"\bREPLACE\s*\(", r"\bSTUFF\s*\(", r"\bUPPER\s*\(|\bLOWER\s*\(",
        r"\bLTRIM\s*\(|\bRTRIM\s*\(|\bTRIM\s*\(", r"\bCONCAT\s*\(|\bCONCAT_WS\s*\(", r"\bSTRING_AGG\s*\(|\bSTRING_SPLIT\s*\(", r"\bhàm\s+chuỗi\b",
    ]),
    ("math_function", [r"\bABS\s*\(", r"\bROUND\s*\(", r"\bCEILING\s*\(|\bFLOOR\s*\(", r"\bPOWER\s*\(|\bSQRT\s*\(", r"\bMODULO\b|%\s*\d+", r"\bhàm\s+số\b|\bhàm\s+toán\b"]),
    ("aggregate_function", [r"\bSUM\s*\(|\bAVG\s*\(|\bCOUNT\s*\(", r"\bMIN\s*\(|\bMAX\s*\(", r"\bGROUP\s+BY\b", r"\bHAVING\b", r"\bDISTINCT\b"]),
    ("conversion_function", [r"\bCAST\s*\(", r"\bCONVERT\s*\(", r"\bTRY_CAST\s*\(|\bTRY_CONVERT\s*\(", r"\bPARSE\s*\(|\bTRY_PARSE\s*\("]),
    ("join", [r"\bINNER\s+JOIN\b", r"\bLEFT\s+(OUTER\s+)?JOIN\b", r"\bRIGHT\s+(OUTER\s+)?JOIN\b", r"\bFULL\s+(OUTER\s+)?JOIN\b", r"\bCROSS\s+JOIN\b"]),
    ("subquery", [r"\bWITH\s+\w+\s+AS\s*\(", r"\bEXISTS\s*\(", r"\bNOT\s+EXISTS\s*\(", r"\bIN\s*\(\s*SELECT\b", r"\bsubquery\b"]),
    ("index", [r"\bCREATE\s+(UNIQUE\s+)?(CLUSTERED\s+|NONCLUSTERED\s+)?INDEX\b", r"\bINCLUDE\s*\(", r"\bCLUSTERED\b|\bNONCLUSTERED\b"]),
    ("view", [r"\bCREATE\s+(OR\s+REPLACE\s+)?VIEW\b", r"\bALTER\s+VIEW\b"]),
    ("ddl", [r"\bCREATE\s+TABLE\b", r"\bALTER\s+TABLE\b", r"\bDROP\s+TABLE\b", r"\bTRUNCATE\s+TABLE\b"]),
    ("dml", [r"\bINSERT\s+(INTO\s+)?\w+", r"\bUPDATE\s+\w+\s+SET\b", r"\bDELETE\s+(FROM\s+)?\w+", r"\bMERGE\s+\w+"]),
    ("engineering_it", [
        r"\b(thuật\s+toán|lập\s+trình|mạng\s+máy\s+tính|bảo\s+mật|mã\s+hóa|phần\s+cứng|phần\s+mềm|hệ\s+điều\s+hành|giao\s+thức|cơ\s+sở\s+dữ\s+liệu|đệ\s+quy|thuật\s+toán|độ\s+phức\s+tạp|cấu\s+trúc\s+dữ\s+liệu)\b",
        r"\b(programming|algorithm|networking|security|cryptography|operating\s+system|protocol|software|hardware|database|recursion|complexity|data\s+structure|api|http|ip\s+address)\b",
    ]),
]

#: Keywords that give a question its topics where no rule matches.
HINTS = [
    ("math_statistics", "toán|thống kê|phương trình|tích phân|đạo hàm|anova|xác suất|math|statistics|equation"),
    ("natural_science", "sinh vật|quang hợp|tế bào|gen|DNA|vật lý|hóa học|phản ứng|lực hấp dẫn|science|physics|biology|chemistry"),
    ("social_science", "lịch sử|triều đại|cách mạng|địa lý|triết học|văn hóa|pháp luật|history|geography|philosophy"),
    ("economics_business", "kinh tế|doanh nghiệp|lợi nhuận|tài chính|đầu tư|cung cầu|lạm phát|finance|business|market"),
    ("engineering_it", "thuật toán|lập trình|mạng|bảo mật|phần mềm|cơ sở dữ liệu|programming|algorithm|software"),
    ("date_function", "ngày|tháng|năm|thời gian|date|time"),
    ("string_function", "chuỗi|ký tự|string|văn bản|text"),
    ("stored_procedure", "thủ tục|stored proc|procedure|exec"),
    ("temp_table", "bảng tạm|temp table|biến bảng|table variable"),
    ("control_flow", "điều kiện|if else|vòng lặp|while|control"),
    ("aggregate_function", "tổng hợp|tổng|đếm|trung bình|group by"),
    ("conversion_function", "chuyển đổi|cast|convert"),
    ("join", "kết hợp bảng|join|kết nối"),
    ("window_function", "cửa sổ|window|rank|row_number|over"),
    ("trigger", "trigger|kích hoạt"),
    ("transaction", "giao dịch|transaction|commit|rollback"),
    ("error_handling", "xử lý lỗi|try catch|error"),
    ("cursor", "con trỏ|cursor"),
]


def _best(text: str, folded: str) -> Column:
    """(n, k, topic) of the topic with most matches of all its patterns; the earlier rule wins ties. Matches are only looked for
    where the folded text holds a word that they need."""
    count = lambda p: F.when(may_match(folded, p), F.regexp_count(F.col(text), F.lit(js_regex(p)))).otherwise(0)
    counts = [F.struct(sum(map(count, patterns), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(topic).alias("topic")) for k, (topic, patterns) in enumerate(TOPICS)]
    return F.array_max(F.array(*counts))


def _text(section: str, content: str) -> Column:
    return F.concat_ws("\n", F.coalesce(section, F.lit("")), F.coalesce(content, F.lit("")))


def _with_best(chunks: DataFrame, asked: Column) -> DataFrame:
    """Chunks with _best where asked. Text, its small letters and the counts are columns of their own, so that they are computed once."""
    rows = chunks.withColumn("_text", F.when(asked, _text("section", "content"))).withColumn("_folded", fold_letters("_text"))
    return rows.withColumn("_best", F.when(F.col("_text").isNotNull(), _best("_text", "_folded"))).drop("_text", "_folded")


def classify_topics(chunks: DataFrame) -> DataFrame:
    """topic of every chunk from its section and content; general if nothing matches."""
    rows = _with_best(chunks, F.lit(True))
    return rows.withColumn("topic", F.when(F.col("_best.n") > 0, F.col("_best.topic")).otherwise("general")).drop("_best")


def backfill_topics(chunks: DataFrame) -> DataFrame:
    """Only chunks without a topic, or with the general one, are classified."""
    is_open = F.col("topic").isNull() | (F.col("topic") == "general")
    new = F.when(F.col("_best.n") > 0, F.col("_best.topic")).otherwise("general")
    return _with_best(chunks, is_open).withColumn("topic", F.when(is_open, new).otherwise(F.col("topic"))).drop("_best")


def infer_topics(questions: DataFrame, column: str = "text") -> DataFrame:
    """topics: every rule that matches, else every hint; empty means no filter."""
    some = lambda tests: reduce(lambda x, y: x | y, tests)
    rule = lambda p: may_match("_folded", p) & F.rlike(F.col(column), F.lit(js_regex(p)))
    by_rule = F.array_compact(F.array(*[F.when(some(map(rule, ps)), F.lit(t)) for t, ps in TOPICS]))
    by_hint = F.array_compact(F.array(*[F.when(some(F.contains(F.col("_lower"), F.lit(w)) for w in words.split("|")), F.lit(t)) for t, words in HINTS]))
    rows = questions.withColumns({"_folded": fold_letters(column), "_lower": F.lower(column)}).withColumn("_rules", by_rule)
    return rows.withColumn("topics", F.when(F.size("_rules") > 0, F.col("_rules")).otherwise(by_hint)).drop("_rules", "_folded", "_lower")
