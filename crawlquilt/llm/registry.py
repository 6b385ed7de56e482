"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from crawlquilt.llm import ann, decontam, jaccard, langid, licenses, linededup, packing, quality, secrets, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": linededup.op1_line_dedup,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_nearest_neighbours": ann.op4_nearest_neighbours,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_url_filter": urlfilter.op6_url_filter,
        "op7_language_id": langid.op7_language_id,
        "op8_secret_scan": secrets.op8_secret_scan,
        "op9_packing": packing.op9_packing,
        "op10_decontaminate": decontam.op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op1_line_dedup": linededup.OP1_SQL, "op3_jaccard_join": jaccard.OP3_SQL, "op6_url_filter": urlfilter.OP6_SQL}
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
