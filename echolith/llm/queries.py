"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from echolith.llm import source_mix, url_filter
from echolith.llm.decontamination import op7_decontamination
from echolith.llm.quality_classifier import op9_quality_classifier
from echolith.llm.quality_rules import op4_quality_rules
from echolith.llm.secret_scan import op10_secret_scans
from echolith.llm.simhash_dedup import op5_simhash_dedup
from echolith.llm.source_mix import op2_source_mix
from echolith.llm.span_dedup import op1_span_dedup
from echolith.llm.suffix_dedup import op8_suffix_dedup
from echolith.llm.token_counts import op3_token_counts
from echolith.llm.url_filter import op6_url_filter

QUERIES = {f.__name__: f for f in (op1_span_dedup, op2_source_mix, op3_token_counts, op4_quality_rules, op5_simhash_dedup, op6_url_filter, op7_decontamination, op8_suffix_dedup, op9_quality_classifier, op10_secret_scans)}
ORACLES = {"op2_source_mix": source_mix.ORACLE, "op6_url_filter": url_filter.ORACLE}
