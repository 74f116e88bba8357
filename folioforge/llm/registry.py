"""The queries of this subpackage and, where SQL can express them, what they must agree with."""

from .cotrain import op4
from .exact_dedup import OP1_SQL, op1
from .mixing import OP3_SQL, op3
from .near_dup import op8
from .packing import op7
from .secrets import op10
from .suffix_dedup import op6
from .topk import OP2_SQL, op2
from .toxicity import op5
from .warc import OP9_SQL, op9

QUERIES = {
    "op1_exact_dedup": op1,
    "op2_topk": op2,
    "op3_mixing": op3,
    "op4_cotrain": op4,
    "op5_toxicity": op5,
    "op6_suffix_dedup": op6,
    "op7_packing": op7,
    "op8_near_dup": op8,
    "op9_warc": op9,
    "op10_secrets": op10,
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op9_warc": OP9_SQL,
}
