"""The queries of this folder, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from corpusloom.llm import chat_format, exact_dedup, jaccard_join, kd_sharding, language_id, mixing, mpeg_audio, personal_data, repeated_spans, sentencepieces, text_quality, token_alignment, vector_codes

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_personal_data": personal_data.op3_personal_data,
    "op4_sentencepiece": sentencepieces.op4_sentencepiece,
    "op5_kd_sharding": kd_sharding.op5_kd_sharding,
    "op6_repeated_spans": repeated_spans.op6_repeated_spans,
    "op7_mpeg_audio": mpeg_audio.op7_mpeg_audio,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_language_id": language_id.op10_language_id,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_text_quality": text_quality.op12_text_quality,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
ORACLE = {
    "op1_chat_format": chat_format.SQL,
    "op2_exact_dedup": exact_dedup.SQL,
}
