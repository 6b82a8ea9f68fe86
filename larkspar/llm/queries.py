"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import cube, digest_index, fertility, hamerly, langid, metric_join, near_dup, packing, pii, sharding, site_templates, toxicity, treaps

QUERIES = {
    "op1_hash_tree": sharding.op1,
    "op2_toxicity": toxicity.op2,
    "op3_fertility": fertility.op3,
    "op4_site_templates": site_templates.op4,
    "op5_sum_of_squares": packing.op5,
    "op6_bigru_langid": langid.op6,
    "op7_oph_near_dup": near_dup.op7,
    "op8_cube_mix": cube.op8,
    "op9_crf_pii": pii.op9,
    "op10_digest_index": digest_index.op10,
    "op11_voronoi_join": metric_join.op11,
    "op12_inverted_treaps": treaps.op12,
    "op13_hamerly": hamerly.op13,
}
SQL = {"op10_digest_index": digest_index.OP10_SQL, "op12_inverted_treaps": treaps.OP12_SQL, "op13_hamerly": hamerly.OP13_SQL}
