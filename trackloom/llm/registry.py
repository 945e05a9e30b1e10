"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from trackloom.llm.bpe import op8_bpe
from trackloom.llm.decontaminate import OP2_SQL, op2_decontamination
from trackloom.llm.embedding_dedup import OP11_SQL, op11_embedding_dedup
from trackloom.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from trackloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from trackloom.llm.language_id import op4_language_id
from trackloom.llm.pii import op9_pii
from trackloom.llm.quality import op1_quality
from trackloom.llm.sharding import op5_sharding
from trackloom.llm.simhash import op10_simhash
from trackloom.llm.spelling_variants import op12_spelling_variants
from trackloom.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from trackloom.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_decontamination": op2_decontamination,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL = {"op2_decontamination": OP2_SQL, "op3_warc": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op11_embedding_dedup": OP11_SQL, "op13_hard_negatives": OP13_SQL}
