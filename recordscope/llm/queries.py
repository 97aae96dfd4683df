"""The registered queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op5_nearest_neighbours
from .bpe import op7_byte_bpe
from .html_text import op9_html_extraction
from .media import op3_media_columns
from .near_duplicates import op2_ngram_jaccard
from .packing import op4_best_fit_packing
from .quality import op1_quality_classifier
from .secrets import OP6_SQL, op6_secret_scans
from .sharding import op8_sharding
from .warc import OP10_SQL, op10_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard, op3_media_columns, op4_best_fit_packing, op5_nearest_neighbours, op6_secret_scans, op7_byte_bpe, op8_sharding, op9_html_extraction, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_scans": OP6_SQL, "op10_warc": OP10_SQL}
