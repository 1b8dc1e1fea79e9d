"""The registered queries of this package and their SQL."""

from __future__ import annotations

from .alignment import op11_cross_tokenizer_alignment
from .chat import op10_chat_formatting
from .collocation import op13_phrase_collocation_mining
from .decontaminate import OP6_SQL, op6_benchmark_decontamination
from .html import op3_html_extraction
from .jaccard import op12_ngram_jaccard_join
from .media import op9_media_columns
from .minhash import op7_minhash_near_dedup
from .oracles import OP2_SQL, OP3_SQL, OP4_SQL, OP7_SQL, OP12_SQL, OP13_SQL
from .sentencepiece import op8_sentencepiece
from .sharding import op1_sharding
from .suffixarray import op4_suffix_array_dedup
from .tokencount import op2_token_counts
from .toxicity import op5_toxicity


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_token_counts": op2_token_counts,
        "op3_html_extraction": op3_html_extraction,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_media_columns": op9_media_columns,
        "op10_chat_formatting": op10_chat_formatting,
        "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
        "op12_ngram_jaccard_join": op12_ngram_jaccard_join,
        "op13_phrase_collocation_mining": op13_phrase_collocation_mining,
    }


def oracle_sql() -> dict:
    return {"op2_token_counts": OP2_SQL, "op3_html_extraction": OP3_SQL, "op4_suffix_array_dedup": OP4_SQL, "op6_benchmark_decontamination": OP6_SQL, "op7_minhash_near_dedup": OP7_SQL, "op12_ngram_jaccard_join": OP12_SQL, "op13_phrase_collocation_mining": OP13_SQL}
