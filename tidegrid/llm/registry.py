"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import debruijn, embedding_dedup, mixing, neighbours, packing, perspectives, prefix_trie, quality, simhash, suffix_dedup, top_k, url_filter, whitening

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_debruijn": debruijn.op3_debruijn,
    "op4_perspectives": perspectives.op4_perspectives,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_quality": quality.op8_quality,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_top_k": top_k.op11_top_k,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_whitening": whitening.op13_whitening,
}
ORACLES = {
    "op4_perspectives": perspectives.OP4_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op7_embedding_dedup": embedding_dedup.OP7_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_top_k": top_k.OP11_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
