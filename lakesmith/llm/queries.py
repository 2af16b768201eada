"""The registered queries of this subpackage and their checks in SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op8_decontamination
from .importance import OP11_SQL, op11_importance
from .line_templates import op7_line_templates
from .lm_scoring import op1_lm_scoring
from .mixing import op9_mixing
from .near_duplicates import op6_near_duplicates
from .packing import op12_packing
from .periodic_runs import op13_periodic_runs
from .personal_data import op4_personal_data
from .quality_classifier import op2_quality_classifier
from .quality_rules import op3_quality_rules
from .sharding import op10_sharding
from .toxicity import op5_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring,
        op2_quality_classifier,
        op3_quality_rules,
        op4_personal_data,
        op5_toxicity,
        op6_near_duplicates,
        op7_line_templates,
        op8_decontamination,
        op9_mixing,
        op10_sharding,
        op11_importance,
        op12_packing,
        op13_periodic_runs,
    )
}

CHECKS: dict[str, str] = {"op11_importance": OP11_SQL}
