"""The queries and oracle SQL of this package, for the driver's entry file."""

from . import bpe, decontamination, fixity, jaccard_join, line_dedup, neighbours, secrets, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_merkle_audit": fixity.op2_merkle_audit,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_nearest": neighbours.op4_nearest,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL = {
    "op2_merkle_audit": fixity.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_jaccard_join": jaccard_join.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
}
