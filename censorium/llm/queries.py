"""The registered queries of this subpackage, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from censorium.llm.byte_bpe import op3_byte_bpe
from censorium.llm.decontaminate import OP13_SQL, op13_decontaminate
from censorium.llm.filter_audit import OP11_SQL, op11_filter_audit
from censorium.llm.fingerprints import op5_fingerprints
from censorium.llm.jaccard_join import OP8_SQL, op8_jaccard_join
from censorium.llm.language_id import op7_language_id
from censorium.llm.metric_topk import OP2_SQL, op2_metric_topk
from censorium.llm.packing import op10_packing
from censorium.llm.periodic_runs import op12_periodic_runs
from censorium.llm.suffix_dedup import op1_suffix_dedup
from censorium.llm.token_files import op6_token_files
from censorium.llm.warc import OP9_SQL, op9_warc
from censorium.llm.wrapper import op4_main_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_suffix_dedup, op2_metric_topk, op3_byte_bpe, op4_main_text, op5_fingerprints, op6_token_files, op7_language_id, op8_jaccard_join, op9_warc, op10_packing, op11_filter_audit, op12_periodic_runs, op13_decontaminate]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_metric_topk": OP2_SQL, "op8_jaccard_join": OP8_SQL, "op9_warc": OP9_SQL, "op11_filter_audit": OP11_SQL, "op13_decontaminate": OP13_SQL}
