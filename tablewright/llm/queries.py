"""The subpackage's queries and their SQL; the entry module adds the pipeline."""

from . import op01_vptree, op02_langid, op03_bpe, op04_quality, op05_secrets, op06_pii, op07_toxicity, op08_simhash, op09_chat, op10_decontam


def queries() -> dict:
    return {
        "op1_vptree": op01_vptree.query,
        "op2_langid": op02_langid.query,
        "op3_bpe": op03_bpe.query,
        "op4_quality": op04_quality.query,
        "op5_secrets": op05_secrets.query,
        "op6_pii": op06_pii.query,
        "op7_toxicity": op07_toxicity.query,
        "op8_simhash": op08_simhash.query,
        "op9_chat": op09_chat.query,
        "op10_decontam": op10_decontam.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_chat": op09_chat.SQL}
