"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bottomk, divergence, exact_exchange, licences, matroska, mixing, ngram_lm, quality, repair, sentencepiece_codec, spotsigs, toxicity, warc


def queries() -> dict:
    return {
        "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
        "op2_spotsigs": spotsigs.op2_spotsigs,
        "op3_bottomk_dedup": bottomk.op3_bottomk_dedup,
        "op4_toxicity_lexicon": toxicity.op4_toxicity_lexicon,
        "op5_licence_digests": licences.op5_licence_digests,
        "op6_backoff_automaton": ngram_lm.op6_backoff_automaton,
        "op7_quality_discriminant": quality.op7_quality_discriminant,
        "op8_warc_zstd": warc.op8_warc_zstd,
        "op9_subset_sum_mix": mixing.op9_subset_sum_mix,
        "op10_matroska": matroska.op10_matroska,
        "op11_agenda_repair": repair.op11_agenda_repair,
        "op12_count_bitmaps": divergence.op12_count_bitmaps,
        "op13_golomb_exchange": exact_exchange.op13_golomb_exchange,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can express a query; the others are tested against brute force, round trips or held-out rows."""
    return {"op2_spotsigs": spotsigs.OP2_SQL, "op3_bottomk_dedup": bottomk.OP3_SQL, "op5_licence_digests": licences.op5_sql(), "op8_warc_zstd": warc.OP8_SQL, "op12_count_bitmaps": divergence.OP12_SQL, "op13_golomb_exchange": exact_exchange.OP13_SQL}
