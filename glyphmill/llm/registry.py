"""Queries of this folder and the SQL they are checked against."""

from . import chat, decontaminate, lines, neardup, packing, quality, scoring, sharding, token_files, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1,
    "op2_token_files": token_files.op2,
    "op3_quality": quality.op3,
    "op4_warc": warc.op4,
    "op5_shards": sharding.op5,
    "op6_lines": lines.op6,
    "op7_neardup": neardup.op7,
    "op8_chat": chat.op8,
    "op9_score": scoring.op9,
    "op10_pack": packing.op10,
}
ORACLES: dict[str, str] = {"op1_decontaminate": decontaminate.OP1_SQL, "op4_warc": warc.OP4_SQL, "op6_lines": lines.OP6_SQL, "op8_chat": chat.OP8_SQL}
