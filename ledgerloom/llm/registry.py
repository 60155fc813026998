"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from . import exact_dedup, filter_audit, fingerprints, license_scan, mixing, near_dedup, neighbours, pii, piece_codec, prefix_trie, quality, secrets, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_pii": pii.op3_pii,
    "op4_source_mix": mixing.op4_source_mix,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_piece_codec": piece_codec.op7_piece_codec,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_document_fingerprints": fingerprints.op10_document_fingerprints,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_nearest_neighbours": neighbours.op13_nearest_neighbours,
}

ORACLE_SQL = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_filter_audit": filter_audit.OP12_SQL,
}
