"""The subpackage's registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import align, bpe, chat, html_extract, jaccard, langid, packing, quality, spelling, token_count, topk, url_filter, warc

QUERIES = {
    "op1_packing": packing.query,
    "op2_url_filter": url_filter.query,
    "op3_html": html_extract.query,
    "op4_langid": langid.query,
    "op5_quality": quality.query,
    "op6_chat": chat.query,
    "op7_bpe": bpe.query,
    "op8_token_counts": token_count.query,
    "op9_jaccard_join": jaccard.query,
    "op10_topk": topk.query,
    "op11_spelling": spelling.query,
    "op12_align": align.query,
    "op13_warc": warc.query,
}

ORACLES: dict[str, str] = {
    "op6_chat": chat.SQL,
    "op10_topk": topk.SQL,
    "op11_spelling": spelling.SQL,
    "op13_warc": warc.SQL,
}
