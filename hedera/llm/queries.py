"""Queries of the text operators and, where SQL can say the same, their SQL."""

from .ann import op2_nearest
from .chat import OP5_SQL, op5_chat
from .licences import op8_licences
from .lines import OP7_SQL, op7_line_dedup
from .lm import op9_lm
from .mixing import op3_mixing
from .near import OP10_SQL, op10_ngram_jaccard
from .pieces import op4_sentencepiece
from .topk import OP1_SQL, op1_exact_topk
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (op1_exact_topk, op2_nearest, op3_mixing, op4_sentencepiece, op5_chat, op6_toxicity, op7_line_dedup, op8_licences, op9_lm, op10_ngram_jaccard)}

SQL = {"op1_exact_topk": OP1_SQL, "op5_chat": OP5_SQL, "op7_line_dedup": OP7_SQL, "op10_ngram_jaccard": OP10_SQL}
