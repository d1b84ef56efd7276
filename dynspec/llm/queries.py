"""Queries of the training-data operators."""

from __future__ import annotations

from . import ann, decontaminate, html, linededup, mixing, pii, quality, secrets, simhash, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_secrets": secrets.op2_secrets,
    "op3_simhash": simhash.op3_simhash,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_mixing": mixing.op6_mixing,
    "op7_html": html.op7_html,
    "op8_ann": ann.op8_ann,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
}

#: SQL where it can express the query.
ORACLE = {
    "op1_warc": warc.OP1_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_pii": pii.OP9_SQL,
}
