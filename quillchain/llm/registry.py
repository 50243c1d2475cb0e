"""Queries and oracle SQL of this subpackage."""

import corpus_pipeline

from . import bagminhash, contamination, langid, media, mixing, sharding, site_style, suffix_dedup, url_filter, warc

QUERIES = {
    "op1_arc_to_warc": warc.op1_arc_to_warc,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_url_filters": url_filter.op3_url_filters,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_media_columns": media.op5_media_columns,
    "op6_site_style": site_style.op6_site_style,
    "op7_shard_best_fit": sharding.op7_shard_best_fit,
    "op8_language_id": langid.op8_language_id,
    "op9_bagminhash": bagminhash.op9_bagminhash,
    "op10_decontaminate": contamination.op10_decontaminate,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op3_url_filters": url_filter.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op10_decontaminate": contamination.ORACLE,
}
