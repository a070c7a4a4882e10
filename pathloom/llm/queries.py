"""The corpus queries by name; SQL only where it can express the whole operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm.audit import OP11_SQL, op11_filter_audit
from pathloom.llm.bpe import op2_bpe
from pathloom.llm.mixing import OP4_SQL, op4_mixing
from pathloom.llm.mtree import OP8_SQL, op8_topk
from pathloom.llm.pii import op5_pii
from pathloom.llm.repair import op9_repair
from pathloom.llm.repeats import op10_repeats
from pathloom.llm.resample import OP12_SQL, op12_resample
from pathloom.llm.simhash import op1_simhash
from pathloom.llm.superkmers import OP13_SQL, op13_superkmers
from pathloom.llm.syncmers import op7_syncmers
from pathloom.llm.toxicity import op3_toxicity
from pathloom.llm.wordpiece import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_token_counts": op6_token_counts,
    "op7_syncmers": op7_syncmers,
    "op8_topk": op8_topk,
    "op9_repair": op9_repair,
    "op10_repeats": op10_repeats,
    "op11_filter_audit": op11_filter_audit,
    "op12_resample": op12_resample,
    "op13_superkmers": op13_superkmers,
}
ORACLE_SQL: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op8_topk": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_resample": OP12_SQL,
    "op13_superkmers": OP13_SQL,
}
