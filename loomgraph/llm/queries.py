"""Queries of the corpus operators by name, and the same results as DuckDB SQL."""

from . import decontam, exact_dedup, langid, lines, minhash, mixing, records, secrets, urls, warc

QUERIES = {
    "op1_decontamination": decontam.query,
    "op2_url_trust": urls.query,
    "op3_warc_derivatives": warc.query,
    "op4_near_dedup": minhash.query,
    "op5_language_id": langid.query,
    "op6_fuzzy_lines": lines.query,
    "op7_source_mix": mixing.query,
    "op8_secret_scan": secrets.query,
    "op9_token_records": records.query,
    "op10_exact_dedup": exact_dedup.query,
    "langid_pages": langid.query_pages,
}
ORACLE = {
    "op1_decontamination": decontam.ORACLE,
    "op4_near_dedup": minhash.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
}
