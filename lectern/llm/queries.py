"""The registered queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from . import op04_substring_dedup, op07_decontamination
from .op01_quality_gam import op1_quality_gam
from .op02_simhash_golay import op2_simhash_golay
from .op03_html_extraction import op3_html_extraction
from .op04_substring_dedup import op4_substring_dedup
from .op05_token_counts import op5_token_counts
from .op06_token_output import op6_token_output
from .op07_decontamination import op7_decontamination
from .op08_quality_rules import op8_quality_rules
from .op09_packing import op9_packing
from .op10_toxicity import op10_toxicity
from .op11_centroid_clustering import ORACLE as CLUSTERS
from .op11_centroid_clustering import op11_centroid_clustering
from .op12_filter_audit import ORACLE as AUDIT
from .op12_filter_audit import op12_filter_audit
from .op13_line_dedup import ORACLE as LINES
from .op13_line_dedup import op13_line_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_gam, op2_simhash_golay, op3_html_extraction, op4_substring_dedup, op5_token_counts,
        op6_token_output, op7_decontamination, op8_quality_rules, op9_packing, op10_toxicity, op11_centroid_clustering, op12_filter_audit,
        op13_line_dedup,
    )
}

#: The others learn a model, read HTML or use tokenizers and hashes that SQL lacks; tests hold them against brute force.
ORACLES = {
    "op4_substring_dedup": op04_substring_dedup.ORACLE,
    "op7_decontamination": op07_decontamination.ORACLE,
    "op11_centroid_clustering": CLUSTERS,
    "op12_filter_audit": AUDIT,
    "op13_line_dedup": LINES,
}
