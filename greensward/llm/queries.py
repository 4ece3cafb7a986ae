"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import divergence, embedding_dedup, set_join, variants, warc
from .decontaminate import op7_decontaminate
from .html_text import op2_html
from .language_id import op13_language
from .license_scan import op10_licenses
from .packing import op4_pack
from .quality import op5_quality
from .token_counts import op1_token_counts
from .url_filter import op8_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_html": op2_html,
    "op3_jaccard": set_join.op3_jaccard,
    "op4_pack": op4_pack,
    "op5_quality": op5_quality,
    "op6_warc": warc.op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_url_filter": op8_url_filter,
    "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
    "op10_licenses": op10_licenses,
    "op11_divergence": divergence.op11_divergence,
    "op12_variants": variants.op12_variants,
    "op13_language": op13_language,
}

SQL: dict[str, str] = {
    "op3_jaccard": set_join.SQL,
    "op6_warc": warc.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
    "op11_divergence": divergence.SQL,
    "op12_variants": variants.SQL,
}
