"""The llm queries and their DuckDB equivalents."""

from __future__ import annotations

from .ann import op7_ann
from .bpe import op10_bpe
from .ctw import op4_ctw
from .decontaminate import op6_decontaminate
from .line_dedup import OP9_SQL, op9_line_dedup
from .ngram_join import op3_ngram_join
from .pii import op1_pii
from .quality import op8_quality
from .suffix_dedup import op2_suffix_dedup
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_ctw": op4_ctw,
    "op5_warc": op5_warc,
    "op6_decontaminate": op6_decontaminate,
    "op7_ann": op7_ann,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_bpe": op10_bpe,
}

ORACLES = {"op5_warc": OP5_SQL, "op9_line_dedup": OP9_SQL}
