"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linkspark.llm import bpe, embedding_dedup, language, minhash, mixing, ogg, secrets, substring_dedup, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix": mixing.op1_mix,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_warc": warc.op3_warc,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
        "op6_bpe": bpe.op6_bpe,
        "op7_language": language.op7_language,
        "op8_secrets": secrets.op8_secrets,
        "op9_ogg": ogg.op9_ogg,
        "op10_minhash": minhash.op10_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix": mixing.ORACLE_SQL,
        "op2_substring_dedup": substring_dedup.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op4_url_filter": url_filter.ORACLE_SQL,
        "op5_embedding_dedup": embedding_dedup.ORACLE_SQL,
        "op8_secrets": secrets.ORACLE_SQL,
        "op10_minhash": minhash.ORACLE_SQL,
    }
