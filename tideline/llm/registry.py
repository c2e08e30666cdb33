"""The queries of this package and the SQL that checks those which SQL can express."""

from tideline.llm.audio import op6
from tideline.llm.chat_format import OP4_SQL, op4
from tideline.llm.line_dedup import OP7_SQL, op7
from tideline.llm.mixing import op5
from tideline.llm.ngram_join import op1
from tideline.llm.packing import op8
from tideline.llm.quality_classifier import op10
from tideline.llm.quality_rules import OP9_SQL, op9
from tideline.llm.spelling import op12
from tideline.llm.substring_lz import op3
from tideline.llm.suffix_dedup import op2
from tideline.llm.token_counts import op13
from tideline.llm.whitening import op11

QUERIES = {"op1_ngram_jaccard_join": op1, "op2_suffix_dedup": op2, "op3_substring_dedup": op3, "op4_chat_format": op4, "op5_mixing": op5, "op6_media_columns": op6, "op7_line_dedup": op7, "op8_best_fit_packing": op8, "op9_quality_rules": op9, "op10_quality_classifier": op10, "op11_whitening": op11, "op12_spelling_variants": op12, "op13_token_counts": op13}
ORACLE_SQL = {"op4_chat_format": OP4_SQL, "op7_line_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL}
