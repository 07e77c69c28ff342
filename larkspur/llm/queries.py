"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op4_bpe
from .caps import OP9_SQL, op9_caps
from .jaccard import OP1_SQL, op1_jaccard
from .language import op3_language
from .lm import op2_lm
from .packing import op10_packing
from .pii import op7_pii
from .quality import op6_quality
from .substring import OP5_SQL, op5_substring
from .topk import OP8_SQL, op8_topk

QUERIES = {f.__name__: f for f in (op1_jaccard, op2_lm, op3_language, op4_bpe, op5_substring, op6_quality, op7_pii, op8_topk, op9_caps, op10_packing)}
SQL = {"op1_jaccard": OP1_SQL, "op5_substring": OP5_SQL, "op8_topk": OP8_SQL, "op9_caps": OP9_SQL}
