"""Operators of a training-data pipeline.  Nothing else in the library imports this subpackage."""

from __future__ import annotations

from .ball_tree import ORACLE_SQL as _ball_tree_sql
from .ball_tree import op13_centroids
from .decontaminate import ORACLE_SQL as _decontaminate_sql
from .decontaminate import op4_decontaminate
from .exact_substrings import op10_repeats
from .flac import op5_flac
from .language import op1_language
from .licenses import op6_licenses
from .main_text import ORACLE_SQL as _main_text_sql
from .main_text import op12_main_text
from .merkle import ORACLE_SQL as _merkle_sql
from .merkle import op11_merkle
from .mixing import ORACLE_SQL as _mixing_sql
from .mixing import op7_mixing
from .quality import op3_quality
from .secrets import ORACLE_SQL as _secrets_sql
from .secrets import op8_secrets
from .simhash import op2_simhash
from .toxicity import op9_toxicity

QUERIES = {
    "op10_repeats": op10_repeats,
    "op1_language": op1_language,
    "op7_mixing": op7_mixing,
    "op4_decontaminate": op4_decontaminate,
    "op8_secrets": op8_secrets,
    "op6_licenses": op6_licenses,
    "op5_flac": op5_flac,
    "op2_simhash": op2_simhash,
    "op3_quality": op3_quality,
    "op9_toxicity": op9_toxicity,
    "op11_merkle": op11_merkle,
    "op12_main_text": op12_main_text,
    "op13_centroids": op13_centroids,
}
ORACLE_SQL: dict[str, str] = {
    "op7_mixing": _mixing_sql,
    "op4_decontaminate": _decontaminate_sql,
    "op8_secrets": _secrets_sql,
    "op11_merkle": _merkle_sql,
    "op12_main_text": _main_text_sql,
    "op13_centroids": _ball_tree_sql,
}
