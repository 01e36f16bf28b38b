"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from .image_copies import op4_image_copies
from .licences import OP3_SQL, op3_licence_scan
from .mixing import op7_mixing, op7_mixing_to_weights
from .packing import op6_packing
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP8_SQL, op8_quality_rules
from .repeats import op5_suffix_array_dedup
from .simhash import op2_simhash_near_dedup
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP1_SQL, op1_warc_writer

QUERIES = {
    "op1_warc_writer": op1_warc_writer,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_licence_scan": op3_licence_scan,
    "op4_image_copies": op4_image_copies,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op7_mixing_to_weights": op7_mixing_to_weights,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES = {
    "op1_warc_writer": OP1_SQL,
    "op3_licence_scan": OP3_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_url_filter": OP9_SQL,
}
