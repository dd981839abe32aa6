"""The queries of this subpackage and their SQL, by name."""

from factloom.llm.align import op13_token_alignment
from factloom.llm.ann import op8_one_bit_search
from factloom.llm.bpe import op11_bpe_round_trip
from factloom.llm.chat import op10_chat_format
from factloom.llm.decontaminate import op4_latent_decontamination
from factloom.llm.manifest import op12_merkle_manifest
from factloom.llm.mixing import op6_fair_queue_mix
from factloom.llm.sharding import op2_feistel_shards
from factloom.llm.simhash import op7_simhash_classes
from factloom.llm.tokens import op9_token_counts
from factloom.llm.toxicity import op1_toxicity
from factloom.llm.urlfilter import OP3_SQL, op3_url_filter
from factloom.llm.warc import OP5_SQL, op5_warc_round_trip

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_feistel_shards": op2_feistel_shards,
    "op3_url_filter": op3_url_filter,
    "op4_latent_decontamination": op4_latent_decontamination,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_fair_queue_mix": op6_fair_queue_mix,
    "op7_simhash_classes": op7_simhash_classes,
    "op8_one_bit_search": op8_one_bit_search,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL = {"op3_url_filter": OP3_SQL, "op5_warc_round_trip": OP5_SQL}
