"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, language_id, license_scan, lm_scoring, media, near_dedup, packing, pii, url_filter, warc


def queries() -> dict:
    return {
        "op1_pack": packing.op1_pack,
        "op2_decontaminate": decontamination.op2_decontaminate,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_near_duplicates": near_dedup.op5_near_duplicates,
        "op6_lm_scores": lm_scoring.op6_lm_scores,
        "op7_pii": pii.op7_pii,
        "op8_warc": warc.op8_warc,
        "op9_language_id": language_id.op9_language_id,
        "op10_media": media.op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontamination.SQL,
        "op3_url_filter": url_filter.SQL,
        "op8_warc": warc.SQL,
    }
