"""What __spark_entry__.py registers of the corpus operators."""

from __future__ import annotations

from gaugespark.llm import heavy_light, license_scan, line_dedup, mixing, near_dedup, periodic_runs, queries, sharding, url_filters

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}
#: The others are held against brute force, exact round trips or held-out accuracy.
ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.ORACLE,
    "op4_virtual_slot_sharding": sharding.ORACLE,
    "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_url_path_templates": url_filters.ORACLE,
    "op9_license_scan": license_scan.ORACLE,
    "op12_ngram_jaccard_join": heavy_light.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
}
