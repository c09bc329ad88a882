"""The queries of this package by name, and the SQL that some of them must agree with."""

from __future__ import annotations

from ledgerlens.llm import (
    curves,
    divergence,
    idfiles,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    resampling,
    tokencount,
    topk,
    urls,
    warc,
)
from ledgerlens.llm.common import importable

QUERIES = {
    "op1_top_k": importable(topk.op1_top_k),
    "op2_url_filter": importable(urls.op2_url_filter),
    "op3_near_duplicates": importable(neardup.op3_near_duplicates),
    "op4_warc": importable(warc.op4_warc),
    "op5_packing": importable(packing.op5_packing),
    "op6_surrogates": importable(pii.op6_surrogates),
    "op7_mixing": importable(mixing.op7_mixing),
    "op8_id_files": importable(idfiles.op8_id_files),
    "op9_nearest": importable(curves.op9_nearest),
    "op10_quality": importable(quality.op10_quality),
    "op11_source_divergence": importable(divergence.op11_source_divergence),
    "op12_token_counts": importable(tokencount.op12_token_counts),
    "op13_importance_resampling": importable(resampling.op13_importance_resampling),
}

SQL = {
    "op1_top_k": topk.SQL,
    "op3_near_duplicates": neardup.SQL,
    "op4_warc": warc.SQL,
    "op11_source_divergence": divergence.SQL,
    "op13_importance_resampling": resampling.SQL,
}
