"""The queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from dairyframe.llm import (
    bigru_language,
    conversation_repair,
    counterfactual_toxicity,
    coordinate_near_dedup,
    digest_index,
    efraimidis_mix,
    ffd_packing,
    hard_negatives,
    license_windows,
    line_runs,
    pii_disclosure,
    suffix_groups,
    tiled_topk,
)

_MODULES = (
    suffix_groups,
    counterfactual_toxicity,
    coordinate_near_dedup,
    bigru_language,
    license_windows,
    ffd_packing,
    efraimidis_mix,
    tiled_topk,
    line_runs,
    digest_index,
    hard_negatives,
    pii_disclosure,
    conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {m.NAME: m.query for m in _MODULES}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {m.NAME: m.ORACLE for m in _MODULES if m.ORACLE}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
