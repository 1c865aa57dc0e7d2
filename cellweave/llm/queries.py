"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cellweave.llm import langid, media, packing, ppm, quality_classifier, quality_rules, sentencepieces, shards, simhash, warc

QUERIES = {
    "op1_sentencepiece": sentencepieces.query,
    "op2_quality_rules": quality_rules.query,
    "op3_simhash": simhash.query,
    "op4_sharding": shards.query,
    "op5_warc": warc.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_packing": packing.query,
    "op8_langid": langid.query,
    "op9_media": media.query,
    "op10_ppm": ppm.query,
}

ORACLE_SQL: dict[str, str] = {"op5_warc": warc.ORACLE}
