"""The registered queries of the training-data operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from foliospark.llm.ann import op9_ann
from foliospark.llm.chat import OP3_SQL, op3_chat
from foliospark.llm.mixing import op10_mixing
from foliospark.llm.pieces import op1_sentencepiece
from foliospark.llm.quality import op5_quality
from foliospark.llm.secret_scan import op6_secrets
from foliospark.llm.sharding import op8_sharding
from foliospark.llm.simhash import op2_simhash
from foliospark.llm.syncmers import op4_syncmers
from foliospark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_chat": op3_chat,
    "op4_syncmers": op4_syncmers,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
}

#: The other operators depend on XXH64, CRC-32, sampling or fitted models, which DuckDB's SQL lacks.
SQL = {"op3_chat": OP3_SQL, "op7_warc": OP7_SQL}
