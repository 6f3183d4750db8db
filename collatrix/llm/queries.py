"""The driver queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collatrix.llm.op1_urls import op1_urls
from collatrix.llm.op2_extract import op2_extract
from collatrix.llm.op10_toxicity import op10_toxicity
from collatrix.llm.op3_lines import op3_lines
from collatrix.llm.op4_jaccard import op4_jaccard
from collatrix.llm.op5_topk import op5_topk
from collatrix.llm.op6_mix import op6_mix
from collatrix.llm.op7_quality import op7_quality
from collatrix.llm.op8_secrets import op8_secrets
from collatrix.llm.op9_decontaminate import op9_decontaminate
from collatrix.llm.oracles import ORACLES

QUERIES = {"op1_urls": op1_urls, "op2_extract": op2_extract, "op3_lines": op3_lines, "op4_jaccard": op4_jaccard, "op5_topk": op5_topk, "op6_mix": op6_mix, "op7_quality": op7_quality, "op8_secrets": op8_secrets, "op9_decontaminate": op9_decontaminate, "op10_toxicity": op10_toxicity}

__all__ = ["ORACLES", "QUERIES"]
