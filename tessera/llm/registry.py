"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exactdup, linededup, neardup, packing, pii, quality, secrets, sharding, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontam.op1_decontamination,
        "op2_packing": packing.op2_packing,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_personal_data": pii.op4_personal_data,
        "op5_near_dedup": neardup.op5_near_dedup,
        "op6_shards": sharding.op6_shards,
        "op7_exact_dedup": exactdup.op7_exact_dedup,
        "op8_url_filter": urlfilter.op8_url_filter,
        "op9_quality": quality.op9_quality,
        "op10_line_dedup": linededup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontam.OP1_SQL,
        "op5_near_dedup": neardup.OP5_SQL,
        "op7_exact_dedup": exactdup.OP7_SQL,
        "op8_url_filter": urlfilter.OP8_SQL,
    }
