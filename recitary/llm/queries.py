"""The operators' queries by name, and SQL for those it can express."""

from __future__ import annotations

from . import (
    op01_url_filter,
    op02_packing,
    op03_secrets,
    op04_html,
    op05_substrings,
    op06_toxicity,
    op07_minhash,
    op08_quality_model,
    op09_quality_rules,
    op10_decontaminate,
    op11_filter_audit,
    op12_whitening,
    op13_cube_mix,
)
from .common import text_batches

_MODULES = {
    "op1_url_filter": op01_url_filter,
    "op2_packing": op02_packing,
    "op3_secrets": op03_secrets,
    "op4_html": op04_html,
    "op5_substrings": op05_substrings,
    "op6_toxicity": op06_toxicity,
    "op7_minhash": op07_minhash,
    "op8_quality_model": op08_quality_model,
    "op9_quality_rules": op09_quality_rules,
    "op10_decontaminate": op10_decontaminate,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_cube_mix": op13_cube_mix,
}


def _query(module):
    return lambda spark, sf_dir: module.query(text_batches(spark), sf_dir)


QUERIES = {name: _query(module) for name, module in _MODULES.items()}
ORACLES = {
    "op1_url_filter": op01_url_filter.oracle(),
    "op5_substrings": op05_substrings.oracle(),
    "op7_minhash": op07_minhash.oracle(),
    "op10_decontaminate": op10_decontaminate.oracle(),
    "op11_filter_audit": op11_filter_audit.oracle(),
}
