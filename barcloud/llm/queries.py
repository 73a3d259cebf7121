"""The registered queries of the subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from barcloud.llm import (
    bitslice, bytebpe, crosstoken, disclosure, language, linededup, packing, postings, quality, repair, simhash, turns, warc,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_language_ppm": language.op1_language_ppm,
        "op2_ann_postings": postings.op2_ann_postings,
        "op3_packing_bounded": packing.op3_packing_bounded,
        "op4_topk_bitslice": bitslice.op4_topk_bitslice,
        "op5_warc_revisits": warc.op5_warc_revisits,
        "op6_bpe_prefixes": bytebpe.op6_bpe_prefixes,
        "op7_ids_repair": repair.op7_ids_repair,
        "op8_pii_disclosure": disclosure.op8_pii_disclosure,
        "op9_quality_weak": quality.op9_quality_weak,
        "op10_simhash_bktree": simhash.op10_simhash_bktree,
        "op11_lines_range": linededup.op11_lines_range,
        "op12_turns_hirschberg": turns.op12_turns_hirschberg,
        "op13_align_identity": crosstoken.op13_align_identity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_topk_bitslice": bitslice.OP4_SQL,
        "op5_warc_revisits": warc.OP5_SQL,
        "op11_lines_range": linededup.OP11_SQL,
        "op12_turns_hirschberg": turns.OP12_SQL,
    }
