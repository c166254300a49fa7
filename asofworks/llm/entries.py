"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, licenses, linededup, minhash, pieces, pii, pivots, ranking, spelling, suffixes, tokencount, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (licenses.op1_license_scan, pieces.op2_sentencepiece, langid.op3_language_id, warc.op4_warc_fixity, linededup.op5_line_dedup, pivots.op6_embedding_dedup, pii.op7_pii, tokencount.op8_token_counts, decontam.op9_decontamination, minhash.op10_minhash, ranking.op11_ranked_search, spelling.op12_spelling_variants, suffixes.op13_suffix_dedup)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.OP1_SQL, "op4_warc_fixity": warc.OP4_SQL, "op5_line_dedup": linededup.OP5_SQL, "op9_decontamination": decontam.OP9_SQL, "op11_ranked_search": ranking.OP11_SQL, "op12_spelling_variants": spelling.OP12_SQL, "op13_suffix_dedup": suffixes.OP13_SQL}
