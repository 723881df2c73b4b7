"""The queries and SQL of this subpackage, for the entry file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .embed import OP5_SQL, op5_cross_polytope
from .exact import OP6_SQL, op6_exact_dedup
from .infill import OP13_SQL, op13_infill
from .katz import op9_katz
from .langid import op3_language
from .license import OP7_SQL, op7_license
from .neighbours import op11_nearest
from .packing import op10_packing
from .simhash import op1_simhash
from .tokenfile import op4_token_files
from .toxicity import op8_toxicity
from .whiten import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_language": op3_language,
    "op4_token_files": op4_token_files,
    "op5_cross_polytope": op5_cross_polytope,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license": op7_license,
    "op8_toxicity": op8_toxicity,
    "op9_katz": op9_katz,
    "op10_packing": op10_packing,
    "op11_nearest": op11_nearest,
    "op12_whitening": op12_whitening,
    "op13_infill": op13_infill,
}

ORACLES: dict[str, str] = {
    "op5_cross_polytope": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op7_license": OP7_SQL,
    "op13_infill": OP13_SQL,
}
