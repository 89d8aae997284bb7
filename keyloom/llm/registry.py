"""The queries of this subpackage: name -> function of (spark, folder of tables)."""

from keyloom.llm.bpe import op7_bpe_codec
from keyloom.llm.brown import op6_brown_lm
from keyloom.llm.minhash import OP10_SQL, op10_minhash_dedup
from keyloom.llm.mixing import op1_mix_sources
from keyloom.llm.quality_model import op8_quality_classifier
from keyloom.llm.quality_rules import OP5_SQL, op5_quality_rules
from keyloom.llm.secrets import op4_secret_scan
from keyloom.llm.topk import OP9_SQL, op9_exact_top_k
from keyloom.llm.toxicity import op3_toxicity
from keyloom.llm.url_filter import op2_url_filter

QUERIES = (op1_mix_sources, op2_url_filter, op3_toxicity, op4_secret_scan, op5_quality_rules, op6_brown_lm, op7_bpe_codec, op8_quality_classifier, op9_exact_top_k, op10_minhash_dedup)


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    return {"op5_quality_rules": OP5_SQL, "op9_exact_top_k": OP9_SQL, "op10_minhash_dedup": OP10_SQL}
