"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .decontaminate import op13_decontamination
from .divergence import op12_source_divergence
from .language import op7_language_id
from .mixing import op9_source_mixing
from .near_duplicates import op6_near_duplicates
from .packing import op1_best_fit_packing
from .pii import op2_personal_data
from .quality import op4_quality
from .token_count import op10_token_counts
from .top_k import op8_top_k
from .vector_codes import op11_vector_codes
from .vector_links import op3_vector_links
from .warc import op5_warc_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_personal_data,
        op3_vector_links,
        op4_quality,
        op5_warc_packages,
        op6_near_duplicates,
        op7_language_id,
        op8_top_k,
        op9_source_mixing,
        op10_token_counts,
        op11_vector_codes,
        op12_source_divergence,
        op13_decontamination,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_warc_packages": sql.OP5, "op8_top_k": sql.OP8, "op11_vector_codes": sql.OP11, "op12_source_divergence": sql.OP12, "op13_decontamination": sql.OP13}
