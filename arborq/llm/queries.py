"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from arborq.llm import bpe, fim, html_text, licenses, mixing, near_dedup, orchard, pii, quality, sharding, topk, toxicity, vectors

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op5_exact_topk": topk.op5_exact_topk,
    "op6_quality": quality.op6_quality,
    "op7_html_text": html_text.op7_html_text,
    "op8_embedding_dedup": vectors.op8_embedding_dedup,
    "op9_license_scan": licenses.op9_license_scan,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_pii": pii.op11_pii,
    "op12_orchard": orchard.op12_orchard,
    "op13_fill_in_middle": fim.op13_fill_in_middle,
}
ORACLE_SQL = {"op5_exact_topk": topk.OP5_SQL, "op9_license_scan": licenses.OP9_SQL, "op12_orchard": orchard.OP12_SQL, "op13_fill_in_middle": fim.OP13_SQL}
