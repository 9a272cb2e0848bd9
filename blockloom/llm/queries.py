"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm import url_lists
from blockloom.llm.alignment import op12_identity_alignment
from blockloom.llm.chat_windows import op3_budgeted_chat_windows
from blockloom.llm.decontaminate import op4_spaced_seed_decontamination
from blockloom.llm.line_dedup import op5_window_line_dedup
from blockloom.llm.ngram_join import op9_prefix_tree_jaccard_join
from blockloom.llm.oracle import ORACLE
from blockloom.llm.packing import op2_vector_packing
from blockloom.llm.quality_rules import op7_line_first_cleaning
from blockloom.llm.ranked_search import op13_block_max_search
from blockloom.llm.resharding import op6_min_cost_resharding
from blockloom.llm.secret_scan import op11_zstd_novelty_secrets
from blockloom.llm.token_files import op1_huffman_token_files
from blockloom.llm.toxicity import op10_toxicity_grammar

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_huffman_token_files,
        op2_vector_packing,
        op3_budgeted_chat_windows,
        op4_spaced_seed_decontamination,
        op5_window_line_dedup,
        op6_min_cost_resharding,
        op7_line_first_cleaning,
        url_lists.op8_temporal_url_lists,
        op9_prefix_tree_jaccard_join,
        op10_toxicity_grammar,
        op11_zstd_novelty_secrets,
        op12_identity_alignment,
        op13_block_max_search,
    )
}

__all__ = ["ORACLE", "QUERIES"]
