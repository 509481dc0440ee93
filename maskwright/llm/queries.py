"""The corpus queries and the SQL that some of them can be held against."""

from __future__ import annotations

from . import op8_decontaminate, op2_warc
from .op1_html import op1_html_template_extraction
from .op2_warc import op2_warc_capture_index
from .op3_bagminhash import op3_bagminhash_near_dedup
from .op4_licenses import op4_license_scan
from .op5_bpe import op5_bpe_round_trip
from .op6_secrets import op6_secret_scan
from .op7_sharding import op7_consistent_hash_sharding
from .op8_decontaminate import op8_ngram_decontamination
from .op9_quality import op9_quality_rules
from .op10_substrings import op10_substring_dedup

QUERIES = {f.__name__: f for f in (
    op1_html_template_extraction, op2_warc_capture_index, op3_bagminhash_near_dedup, op4_license_scan, op5_bpe_round_trip,
    op6_secret_scan, op7_consistent_hash_sharding, op8_ngram_decontamination, op9_quality_rules, op10_substring_dedup,
)}
SQL = {"op2_warc_capture_index": op2_warc.SQL, "op8_ngram_decontamination": op8_decontaminate.SQL}
