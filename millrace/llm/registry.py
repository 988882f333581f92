"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloom_sketch, compression_language, disclosure, entropy_mix, license_scan, line_crf, main_text, order_minhash, piece_codec, source_divergence, spelling_variants, suffix_tree_lm, transport_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": main_text.query,
    "op2_license_scan": license_scan.query,
    "op3_sentencepiece": piece_codec.query,
    "op4_entropy_mix": entropy_mix.query,
    "op5_bloom_sketch": bloom_sketch.query,
    "op6_line_crf": line_crf.query,
    "op7_disclosure": disclosure.query,
    "op8_language": compression_language.query,
    "op10_order_minhash": order_minhash.query,
    "op9_transport_stream": transport_stream.query,
    "op11_source_divergence": source_divergence.query,
    "op12_spelling_variants": spelling_variants.query,
    "op13_suffix_tree": suffix_tree_lm.query,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": license_scan.ORACLE,
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_spelling_variants": spelling_variants.ORACLE,
}
