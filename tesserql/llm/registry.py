"""The queries of this package and their SQL, for `__spark_entry__`."""

from __future__ import annotations

from . import ann, exact_topk, licenses, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_exact_topk": exact_topk.op3_exact_topk,
    "op4_quality": quality.op4_quality,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_nearest": ann.op9_nearest,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op3_exact_topk": exact_topk.OP3_SQL,
    "op6_near_dedup": near_dedup.OP6_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
}
