"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op01_packing import op1_packing
from .op02_lm import op2_lm
from .op03_lines import op3_lines
from .op04_toxicity import op4_toxicity
from .op05_simhash import op5_simhash
from .op06_warc import ORACLE as WARC_SQL
from .op06_warc import op6_warc
from .op07_ann import op7_ann
from .op08_rules import ORACLE as RULES_SQL
from .op08_rules import op8_rules
from .op09_mixing import op9_mixing
from .op10_language import op10_language


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_lm, op3_lines, op4_toxicity, op5_simhash, op6_warc, op7_ann, op8_rules, op9_mixing, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op6_warc": WARC_SQL, "op8_rules": RULES_SQL}
