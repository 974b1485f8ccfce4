"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from . import embed_dedup, html_extract, huffman, langid, media, minhash, mixing, packing, phrases, prefix_trie, quality, suffix_dedup, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_minhash": minhash.op2_minhash,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_media": media.op7_media,
    "op8_embed_dedup": embed_dedup.op8_embed_dedup,
    "op9_langid": langid.op9_langid,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_token_ids": huffman.op11_token_ids,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {"op10_url_filter": url_filter.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_phrases": phrases.ORACLE}
