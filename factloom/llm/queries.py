"""The queries of this package by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from factloom.llm.chat_format import OP11_SQL, op11_chat_format
from factloom.llm.decontamination import op7_decontamination
from factloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from factloom.llm.language_id import op6_language_id
from factloom.llm.license_scan import OP2_SQL, op2_license_scan
from factloom.llm.near_duplicates import op5_near_duplicates
from factloom.llm.packing import op1_best_fit_packing
from factloom.llm.quality import op8_quality_classifier
from factloom.llm.secret_scan import op3_secret_scan
from factloom.llm.spelling import OP13_SQL, op13_spelling_variants
from factloom.llm.topk_search import OP4_SQL, op4_topk_search
from factloom.llm.url_filter import op10_url_filter
from factloom.llm.warc import OP9_SQL, op9_warc

QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_secret_scan, op4_topk_search, op5_near_duplicates, op6_language_id, op7_decontamination, op8_quality_classifier, op9_warc, op10_url_filter, op11_chat_format, op12_hard_negatives, op13_spelling_variants)}
ORACLES: dict[str, str] = {"op2_license_scan": OP2_SQL, "op4_topk_search": OP4_SQL, "op9_warc": OP9_SQL, "op11_chat_format": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_spelling_variants": OP13_SQL}
