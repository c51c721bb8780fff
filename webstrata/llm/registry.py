"""The queries of the text operators, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from webstrata.llm.bag_minhash import op9_bag_minhash
from webstrata.llm.chat_format import OP7_SQL, op7_chat_format
from webstrata.llm.decontaminate import OP1_SQL, op1_decontaminate
from webstrata.llm.language_id import op4_language
from webstrata.llm.log_bilinear import op10_log_bilinear
from webstrata.llm.phrase_mining import OP13_SQL, op13_phrases
from webstrata.llm.pii_surrogates import op5_pii_surrogates
from webstrata.llm.quality_divergence import op3_quality_divergence
from webstrata.llm.ranked_search import OP11_SQL, op11_ranked_search
from webstrata.llm.sentencepiece_codec import op6_sentencepiece
from webstrata.llm.substring_dedup import OP12_SQL, op12_substring_dedup
from webstrata.llm.token_counts import op2_token_counts
from webstrata.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_quality_divergence": op3_quality_divergence,
    "op4_language": op4_language,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_bag_minhash": op9_bag_minhash,
    "op10_log_bilinear": op10_log_bilinear,
    "op11_ranked_search": op11_ranked_search,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op7_chat_format": OP7_SQL, "op11_ranked_search": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_phrases": OP13_SQL}
