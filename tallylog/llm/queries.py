"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import ann, chroma, html_text, langid, manifest, mixing, neardup, packing, pii, resampling, sharding, substring, suffix_array

QUERIES = {f.__name__: f for f in (chroma.op1_chroma_alignment, langid.op2_byte_cnn, sharding.op3_histogram_sort, mixing.op4_systematic_mix, substring.op5_suffix_trees, packing.op6_best_fit, pii.op9_feistel_pseudonyms, html_text.op7_min_cut, ann.op8_anisotropic_search, neardup.op10_minhash_join, manifest.op11_merkle_manifest, suffix_array.op12_interval_expansion, resampling.op13_word_trie_resampling)}
ORACLES = {"op4_systematic_mix": mixing.OP4_SQL, "op5_suffix_trees": substring.OP5_SQL, "op10_minhash_join": neardup.OP10_SQL, "op11_merkle_manifest": manifest.OP11_SQL, "op12_interval_expansion": suffix_array.OP12_SQL, "op13_word_trie_resampling": resampling.OP13_SQL}
