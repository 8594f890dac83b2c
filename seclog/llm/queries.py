"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from seclog.llm import archive, bpe, exact, katz, mixing, packing, prefix_trie, quality, repair, simhash, token_counts, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        token_files.op1_token_files,
        quality.op2_line_quality,
        bpe.op3_word_bpe,
        simhash.op4_near_copies,
        archive.op5_web_archive,
        exact.op6_exact_copies,
        token_counts.op7_token_counts,
        mixing.op8_mix_sources,
        toxicity.op9_toxicity,
        katz.op10_katz_scores,
        repair.op11_repair_conversations,
        packing.op12_pack_sequences,
        prefix_trie.op13_prefix_trie,
    )
}
ORACLES = {"op5_web_archive": archive.OP5_SQL, "op6_exact_copies": exact.OP6_SQL}
