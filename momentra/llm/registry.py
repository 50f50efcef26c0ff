"""The queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from . import ann, chat, license_scan, mixing, near_dedup, packing, quality, sharding, substring_dedup, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        license_scan.op1_license_scan, packing.op2_packing, ann.op3_ann, mixing.op4_mixing, substring_dedup.op5_substring_dedup,
        near_dedup.op6_near_dedup, toxicity.op7_toxicity, quality.op8_quality, sharding.op9_sharding, chat.op10_chat,
    )
}

ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op8_quality": quality.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op10_chat": chat.OP10_SQL,
}
