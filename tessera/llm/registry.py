"""The corpus operators' queries, by name, and the DuckDB statements that say what they return; the pipeline made of
them is a script of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe import op6_byte_bpe
from .divergence import op11_source_divergence
from .filteraudit import op13_filter_audit
from .html_extract import op1_html_extraction
from .langid import op8_language_id
from .mixing import op7_mixing
from .neardup import op3_minhash_neardup
from .pii import op4_pii_surrogates
from .quality import op10_quality_rules
from .secretscan import op12_secret_scan
from .sharding import op2_sharding
from .urlfilter import op9_url_filter
from .vectors import op5_embedding_neardup

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_sharding": op2_sharding,
        "op3_minhash_neardup": op3_minhash_neardup,
        "op4_pii_surrogates": op4_pii_surrogates,
        "op5_embedding_neardup": op5_embedding_neardup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_mixing": op7_mixing,
        "op8_language_id": op8_language_id,
        "op9_url_filter": op9_url_filter,
        "op10_quality_rules": op10_quality_rules,
        "op11_source_divergence": op11_source_divergence,
        "op12_secret_scan": op12_secret_scan,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """The others are learnt, keyed or recursive beyond what one statement can say; the tests hold them against brute force."""
    return {"op3_minhash_neardup": oracles.OP3, "op5_embedding_neardup": oracles.OP5, "op11_source_divergence": oracles.OP11, "op13_filter_audit": oracles.OP13}
