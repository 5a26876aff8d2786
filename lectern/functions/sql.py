"""Column builders as functions of SQL text: CREATE TEMPORARY FUNCTION for a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters, type and body. Bodies are SQL, so Catalyst puts them into the query and no Python runs. They say
#: what the Column builders of the same names say; the tests hold the two against each other.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    (
        "cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "CASE WHEN size(a) = size(b) THEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)"
        " / (sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) * sqrt(aggregate(b, 0D, (s, v) -> s + v * v)) + 1e-9D) ELSE 0D END",
    ),
    ("jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    (
        "bloom_level", "day INT, days INT", "STRING",
        "element_at(array('remember', 'understand', 'apply', 'analyze', 'evaluate', 'create'), 1 + CAST(least(5, floor((day - 1) / greatest(1, days - 1) * 6)) AS INT))",
    ),
    (
        "heading_level", "line STRING", "INT",
        r"""CAST(CASE WHEN line RLIKE r'^#{1,4}\s+\S' THEN length(regexp_extract(line, r'^(#{1,4})\s', 1))
        WHEN trim(line) RLIKE r'^[0-9]+(?:\.[0-9]+)*\s+[A-ZÀ-Ỹa-zà-ỹ]' THEN least(regexp_count(trim(line), r'\.') + 1, 4)
        WHEN trim(line) RLIKE r'^[A-Z]\.\s+[A-ZÀ-Ỹa-zà-ỹ]' THEN 2
        WHEN trim(line) RLIKE r'(?i)^(?:I{1,3}|IV|V?I{0,3}|IX|X{0,3})\.\s+[A-ZÀ-Ỹa-zà-ỹ]' AND length(trim(line)) <= 100 AND size(filter(split(trim(line), r'\s+'), x -> x <> '')) >= 3 THEN 1
        WHEN trim(line) RLIKE r'(?iu)^(?:chương|chapter|phần|section|part|module|unit|bài|mục|topic|lesson)\s+(?:[0-9]+|[IVX]+)' THEN 1
        WHEN size(filter(split(trim(line), r'\s+'), x -> x <> '')) >= 2 AND length(trim(line)) BETWEEN 4 AND 80 AND trim(line) = upper(trim(line))
          AND trim(line) RLIKE r'[A-ZÀ-Ỹ]' AND NOT trim(line) RLIKE r'[{}()\[\];=]' THEN 2 ELSE 0 END AS INT)""",
    ),
]


def register(spark: SparkSession) -> list[str]:
    """Define the functions for the session; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
