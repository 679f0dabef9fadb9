"""The queries of this folder and the SQL they are checked against."""

from __future__ import annotations

from marginalia.llm import (
    bpe, decontaminate, lexical, merkle, mixing, negatives, packing, pii, secret_scan, sharding, simhash, toxicity, warc,
)


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_merkle_fingerprints": merkle.op2,
        "op3_warc": warc.op3,
        "op4_stratified_shards": sharding.op4,
        "op5_guess_cost_secrets": secret_scan.op5,
        "op6_byte_bpe": bpe.op6,
        "op7_fm_index_decontamination": decontaminate.op7,
        "op8_weak_supervision_pii": pii.op8,
        "op9_counterfactual_toxicity": toxicity.op9,
        "op10_simhash_near_duplicates": simhash.op10,
        "op11_capped_mixing": mixing.op11,
        "op12_pair_bound_maxscore": lexical.op12,
        "op13_gnat_hard_negatives": negatives.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op7_fm_index_decontamination": decontaminate.SQL,
            "op11_capped_mixing": mixing.SQL,
            "op12_pair_bound_maxscore": lexical.SQL, "op13_gnat_hard_negatives": negatives.SQL}
