"""The queries of this subpackage, for registration, and the SQL of those that SQL can express."""

from __future__ import annotations

from archivolt.llm.byte_bpe import op8_byte_bpe
from archivolt.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from archivolt.llm.fill_middle import op13_fill_in_middle
from archivolt.llm.line_dedup import OP7_SQL, op7_line_dedup
from archivolt.llm.packing import op4_packing
from archivolt.llm.pii import op5_pii
from archivolt.llm.quality_classifier import op9_quality_classifier
from archivolt.llm.quality_rules import op10_quality_rules
from archivolt.llm.schema_rewrite import op12_drifted_schema_rewrite
from archivolt.llm.simhash import op1_simhash_near_dedup
from archivolt.llm.suffix_dedup import op2_suffix_array_dedup
from archivolt.llm.toxicity import op11_toxicity
from archivolt.llm.url_filter import OP3_SQL, op3_url_filter

_QUERIES = (
    op1_simhash_near_dedup, op2_suffix_array_dedup, op3_url_filter, op4_packing, op5_pii, op6_exact_dedup, op7_line_dedup,
    op8_byte_bpe, op9_quality_classifier, op10_quality_rules, op11_toxicity, op12_drifted_schema_rewrite,
    op13_fill_in_middle,
)


def queries() -> dict:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict:
    return {"op3_url_filter": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL}
