"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, cotrain, decontam, licences, linededup, lm, maxscore, pieces, sharding, simhash

QUERIES = {
    "op1_lm": lm.op1_lm,
    "op2_simhash": simhash.op2_simhash,
    "op3_shards": sharding.op3_shards,
    "op4_licences": licences.op4_licences,
    "op5_chat": chat.op5_chat,
    "op6_decontaminate": decontam.op6_decontaminate,
    "op7_quality": cotrain.op7_quality,
    "op8_lines": linededup.op8_lines,
    "op9_pieces": pieces.op9_pieces,
    "op10_topk": maxscore.op10_topk,
}
SQL = {"op3_shards": sharding.OP3_SQL, "op4_licences": licences.OP4_SQL, "op5_chat": chat.OP5_SQL, "op6_decontaminate": decontam.OP6_SQL, "op10_topk": maxscore.OP10_SQL}
