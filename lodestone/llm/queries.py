"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, hilbert, jaccard, langid, mainpage, packing, secrets, urls, winnow, wordpiece

QUERIES = {
    "op1_crf_langid": langid.op1_crf_langid,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_main_text": mainpage.op3_main_text,
    "op4_winnowing": winnow.op4_winnowing,
    "op5_jaccard_join": jaccard.op5_jaccard_join,
    "op6_config_lp_packing": packing.op6_config_lp_packing,
    "op7_url_filter": urls.op7_url_filter,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_hilbert_sharding": hilbert.op9_hilbert_sharding,
    "op10_token_counts": wordpiece.op10_token_counts,
}

ORACLE_SQL = {"op5_jaccard_join": jaccard.OP5_SQL, "op7_url_filter": urls.OP7_SQL, "op8_decontamination": decontaminate.OP8_SQL}
