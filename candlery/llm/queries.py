"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_decontamination": "decontaminate",
    "op2_bpe": "bpe",
    "op3_quality": "quality",
    "op4_suffix_dedup": "suffix",
    "op5_url_filter": "urls",
    "op6_media_columns": "media",
    "op7_warc": "warc",
    "op8_substring_dedup": "substrings",
    "op9_jaccard_join": "jaccard",
    "op10_toxicity": "toxicity",
    "op11_source_divergence": "divergence",
    "op12_quality_rules": "rules",
    "op13_hard_negatives": "negatives",
}


def _query(name: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"{__package__}.{_MODULES[name]}"), name)(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
