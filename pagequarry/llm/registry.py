"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from pagequarry.llm import (
    decontaminate, langmodel, licenses, negatives, packing, periodic, quality, repeats, simhash, suffixes, topk, toxicity, warc
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_warc": warc.op2_warc,
    "op3_quality": quality.op3_quality,
    "op4_topk": topk.op4_topk,
    "op5_packing": packing.op5_packing,
    "op6_repeats": repeats.op6_repeats,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_simhash": simhash.op9_simhash,
    "op10_langmodel": langmodel.op10_langmodel,
    "op11_licenses": licenses.op11_licenses,
    "op12_negatives": negatives.op12_negatives,
    "op13_runs": periodic.op13_runs,
}
ORACLES = {
    "op7_suffixes": suffixes.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op4_topk": topk.ORACLE_SQL,
    "op6_repeats": repeats.ORACLE_SQL,
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op11_licenses": licenses.ORACLE_SQL,
    "op12_negatives": negatives.ORACLE_SQL,
    "op13_runs": periodic.ORACLE_SQL,
}
