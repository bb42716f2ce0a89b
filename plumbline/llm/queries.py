"""The queries of this subpackage, and SQL for those that it can express."""

from . import bpe, lm, minhash, mixing, nndescent, quality, secretscan, tokencount, toxicity, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1,
    "op2_pseudo_likelihood": lm.op2,
    "op3_nn_descent": nndescent.op3,
    "op4_chosen_path": minhash.op4,
    "op5_toxicity": toxicity.op5,
    "op6_warc": warc.op6,
    "op7_token_counts": tokencount.op7,
    "op8_secrets": secretscan.op8,
    "op9_mixing": mixing.op9,
    "op10_host_quality": quality.op10,
}
ORACLE_SQL = {"op9_mixing": mixing.OP9_SQL, "op10_host_quality": quality.OP10_SQL}
