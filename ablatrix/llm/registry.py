"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, bpe, clusters, licences, media, mixing, near_dup, pii, secret_scan, toxicity, vector_codes, vector_dups, warc

QUERIES = {
    "op1_media": media.op1_media,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_pii": pii.op3_pii,
    "op4_licences": licences.op4_licences,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_neighbours": ann.op9_neighbours,
    "op10_mixing": mixing.op10_mixing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_clusters": clusters.op12_clusters,
    "op13_vector_dups": vector_dups.op13_vector_dups,
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.ORACLE, "op10_mixing": mixing.oracle(), "op11_vector_codes": vector_codes.oracle(), "op12_clusters": clusters.oracle(), "op13_vector_dups": vector_dups.oracle(),
}
