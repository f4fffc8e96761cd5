"""The queries of this subpackage and their SQL, where SQL can express them."""

from . import chat, codes, compress, mixing, nearest, packing, periods, pieces, rules, shards, simhash, token_files

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_pack": packing.op2_pack,
    "op3_piece_counts": pieces.op3_piece_counts,
    "op4_mix": mixing.op4_mix,
    "op5_token_files": token_files.op5_token_files,
    "op6_language": compress.op6_language,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": compress.op8_quality,
    "op9_nearest": nearest.op9_nearest,
    "op10_rules": rules.op10_rules,
    "op11_codes": codes.op11_codes,
    "op12_shards": shards.op12_shards,
    "op13_periods": periods.op13_periods,
}
SQL = {"op1_chat": chat.OP1_SQL, "op4_mix": mixing.OP4_SQL, "op10_rules": rules.OP10_SQL, "op11_codes": codes.OP11_SQL}
