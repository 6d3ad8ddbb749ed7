"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from . import (
    byte_cnn,
    dac_tokens,
    digest_tree,
    dom_boost,
    hilbert_shards,
    jaccard_join,
    license_scan,
    piece_chunks,
    prefix_trie,
    secret_scan,
    source_mix,
    spaced_seeds,
    token_alignment,
)

QUERIES = {
    "op1_hilbert_shards": hilbert_shards.op1_hilbert_shards,
    "op2_digest_tree": digest_tree.op2_digest_tree,
    "op3_byte_cnn": byte_cnn.op3_byte_cnn,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_dom_boost": dom_boost.op5_dom_boost,
    "op6_trigram_secrets": secret_scan.op6_trigram_secrets,
    "op7_source_mix": source_mix.op7_source_mix,
    "op8_spaced_seeds": spaced_seeds.op8_spaced_seeds,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_dac_tokens": dac_tokens.op10_dac_tokens,
    "op11_piece_chunks": piece_chunks.op11_piece_chunks,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

SQL = {
    "op2_digest_tree": digest_tree.OP2_SQL,
    "op7_source_mix": source_mix.OP7_SQL,
    "op9_jaccard_join": jaccard_join.OP9_SQL,
}
