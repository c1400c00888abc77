"""The queries of this subpackage and, where SQL can state them, their oracles."""

from __future__ import annotations

from . import bpe, exact, mixing, perplexity, quality, simhash, spelling, substring, suffix, tokenfile, topk, trie, urls

QUERIES = {
    "op1_exact_dedup": exact.op1_exact_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_url_rules": urls.op4_url_rules,
    "op5_perplexity": perplexity.op5_perplexity,
    "op6_token_files": tokenfile.op6_token_files,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_pivot_topk": topk.op12_pivot_topk,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE = {"op1_exact_dedup": exact.OP1_SQL, "op4_url_rules": urls.OP4_SQL, "op12_pivot_topk": topk.OP12_SQL}
