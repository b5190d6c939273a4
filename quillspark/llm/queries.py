"""The queries of this subpackage and the SQL that they are held against."""

from __future__ import annotations

from quillspark.llm.bpe import op3_byte_bpe
from quillspark.llm.pii import op4_personal_data
from quillspark.llm.quality import OP2_SQL, op2_quality_rules
from quillspark.llm.jaccard import OP8_SQL, op8_jaccard_join
from quillspark.llm.mixing import OP7_SQL, op7_mix_sources
from quillspark.llm.secrets import OP6_SQL, op6_secret_scan
from quillspark.llm.token_store import op1_token_store
from quillspark.llm.toxicity import op5_toxicity
from quillspark.llm.urls import OP10_SQL, op10_url_filter
from quillspark.llm.vectors import OP9_SQL, op9_embedding_near_dedup

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_mix_sources": op7_mix_sources,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_url_filter": op10_url_filter,
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op6_secret_scan": OP6_SQL,
    "op7_mix_sources": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op10_url_filter": OP10_SQL,
}
