"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .decontaminate import OP8_SQL, op8_decontaminate
from .exact import OP2_SQL, op2_exact_dedup
from .jaccard import OP4_SQL, op4_jaccard
from .packing import op6_pack
from .pii import op1_pii
from .quality import op10_quality
from .repeats import op7_repeats
from .tokens import op5_token_files
from .urls import OP9_SQL, op9_url_filter
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_jaccard": op4_jaccard,
    "op5_token_files": op5_token_files,
    "op6_pack": op6_pack,
    "op7_repeats": op7_repeats,
    "op8_decontaminate": op8_decontaminate,
    "op9_url_filter": op9_url_filter,
    "op10_quality": op10_quality,
}

SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op4_jaccard": OP4_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_url_filter": OP9_SQL,
}
