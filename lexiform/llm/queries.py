"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexiform.llm.bpe import op6_byte_bpe
from lexiform.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from lexiform.llm.html_text import op8_html_extraction
from lexiform.llm.jaccard import op2_ngram_jaccard
from lexiform.llm.line_dedup import OP1_SQL, op1_line_dedup
from lexiform.llm.media import op10_media_columns
from lexiform.llm.mixing import op5_mixing
from lexiform.llm.quality import op7_quality_classifier
from lexiform.llm.sharding import OP9_SQL, op9_sharding
from lexiform.llm.substring_dedup import OP3_SQL, op3_substring_dedup

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_extraction": op8_html_extraction,
    "op9_sharding": op9_sharding,
    "op10_media_columns": op10_media_columns,
}
#: SQL can't express operators 2 (fast enough on whole tables), 5, 6, 7, 8 and 10; tests hold them against brute force, round trips and held-out labels.
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op9_sharding": OP9_SQL,
}
