"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import alignment, contamination, embeddings, html, minhash, mixing, negatives, packing, quality, rules, sharding, suffix, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_minhash": minhash.op2_minhash,
    "op3_packing": packing.op3_packing,
    "op4_urls": urls.op4_urls,
    "op5_embeddings": embeddings.op5_embeddings,
    "op6_quality": quality.op6_quality,
    "op7_suffix": suffix.op7_suffix,
    "op8_sharding": sharding.op8_sharding,
    "op9_html": html.op9_html,
    "op10_rules": rules.op10_rules,
    "op11_negatives": negatives.op11_negatives,
    "op12_contamination": contamination.op12_contamination,
    "op13_alignment": alignment.op13_alignment,
}
ORACLES: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op5_embeddings": embeddings.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op10_rules": rules.OP10_SQL,
    "op11_negatives": negatives.OP11_SQL,
    "op12_contamination": contamination.OP12_SQL,
}
