"""Registered queries of this subpackage: each applies its operator to the whole table."""

from __future__ import annotations

from plumbline.llm import negatives, topk, warc
from plumbline.llm.counts import op8_token_counts
from plumbline.llm.decontam import op3_decontaminate
from plumbline.llm.fingerprints import op12_fingerprints
from plumbline.llm.jaccard import op7_jaccard_join
from plumbline.llm.packing import op10_pack
from plumbline.llm.pii import op9_personal_data
from plumbline.llm.quality import op5_quality
from plumbline.llm.secrets import op4_secrets
from plumbline.llm.turns import op11_repair
from plumbline.llm.urls import op6_url_filter

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_revisits": warc.op2_revisits,
    "op3_decontaminate": op3_decontaminate,
    "op4_secrets": op4_secrets,
    "op5_quality": op5_quality,
    "op6_url_filter": op6_url_filter,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_token_counts": op8_token_counts,
    "op9_personal_data": op9_personal_data,
    "op10_pack": op10_pack,
    "op11_repair": op11_repair,
    "op12_fingerprints": op12_fingerprints,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
TWINS: dict[str, str] = {"op1_topk": topk.TWIN, "op2_revisits": warc.TWIN, "op13_hard_negatives": negatives.TWIN}
