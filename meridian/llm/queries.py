"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from meridian.llm import (
    embedding_dedup,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    pii,
    quality_rules,
    sharding,
    simhash,
    token_output,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_packing": packing.op3_packing,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_pii": pii.op7_pii,
    "op8_token_output": token_output.op8_token_output,
    "op9_sharding": sharding.op9_sharding,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
}

SQL = {
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
}
