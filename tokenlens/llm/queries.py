"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import op13_divergence, op13_sql
from .fill_middle import op11_fill_middle, op11_sql
from .katz import op9_katz
from .language_id import op1_language
from .licenses import op7_licenses, op7_sql
from .packing import op5_packing
from .piece_codec import op3_pieces
from .quality_rules import op8_quality
from .sharding import op6_sharding
from .simhash import op2_simhash
from .spherical_caps import op4_vectors
from .suffix_dedup import op10_suffix
from .toxicity import op12_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_language, op2_simhash, op3_pieces, op4_vectors, op5_packing, op6_sharding, op7_licenses, op8_quality, op9_katz, op10_suffix, op11_fill_middle, op12_toxicity, op13_divergence)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_licenses": op7_sql(), "op11_fill_middle": op11_sql(), "op13_divergence": op13_sql()}
