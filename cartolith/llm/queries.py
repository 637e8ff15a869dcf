"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from . import bpe, chat_format, collocations, conversation_repair, decontaminate, exact_topk, line_dedup, ngram_join, pii, quality_classifier, quality_rules, substring_dedup, token_orc

QUERIES = {
    "op1_feistel_pseudonyms": pii.op1_feistel_pseudonyms,
    "op2_chat_tokens": chat_format.op2_chat_tokens,
    "op3_bpe_rank_array": bpe.op3_bpe_rank_array,
    "op4_risk_controlled_rules": quality_rules.op4_risk_controlled_rules,
    "op5_random_indexing_network": quality_classifier.op5_random_indexing_network,
    "op6_orc_token_ids": token_orc.op6_orc_token_ids,
    "op7_paragraph_minhash": substring_dedup.op7_paragraph_minhash,
    "op8_line_windows": line_dedup.op8_line_windows,
    "op9_bayes_ngram_join": ngram_join.op9_bayes_ngram_join,
    "op10_wu_manber": decontaminate.op10_wu_manber,
    "op11_phrase_levels": collocations.op11_phrase_levels,
    "op12_layered_repair": conversation_repair.op12_layered_repair,
    "op13_histogram_topk": exact_topk.op13_histogram_topk,
}

ORACLE_SQL = {
    "op2_chat_tokens": chat_format.OP2_SQL,
    "op8_line_windows": line_dedup.OP8_SQL,
    "op4_risk_controlled_rules": quality_rules.OP4_SQL,
    "op9_bayes_ngram_join": ngram_join.OP9_SQL,
    "op10_wu_manber": decontaminate.OP10_SQL,
    "op11_phrase_levels": collocations.OP11_SQL,
    "op12_layered_repair": conversation_repair.OP12_SQL,
    "op13_histogram_topk": exact_topk.OP13_SQL,
}
