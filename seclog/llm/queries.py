"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, quality_rules, url_filter, warc
from .ann import op3_ann
from .bpe import op6_bpe
from .classifier import op10_classifier
from .langid import op7_langid
from .lm import op8_lm
from .mixing import op9_mixing
from .negatives import op11_hard_negatives
from .pieces import op13_sentencepiece
from .quality_rules import op4_quality_rules
from .simhash import op1_simhash
from .url_filter import op5_url_filter
from .warc import op2_warc
from .whitening import op12_whitening

ALL = (op1_simhash, op2_warc, op3_ann, op4_quality_rules, op5_url_filter, op6_bpe, op7_langid, op8_lm, op9_mixing, op10_classifier, op11_hard_negatives, op12_whitening, op13_sentencepiece)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.SQL, "op4_quality_rules": quality_rules.SQL, "op5_url_filter": url_filter.SQL, "op9_mixing": mixing.SQL}
