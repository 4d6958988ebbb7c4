"""The registered queries of this package and their check SQL."""

from __future__ import annotations

from dossier.llm.conversations import OP11_SQL, op11_conversation_repair
from dossier.llm.dart_minhash import op10_dart_minhash
from dossier.llm.decontaminate import OP5_SQL, op5_decontaminate
from dossier.llm.fim import OP13_SQL, op13_fill_in_middle
from dossier.llm.html_text import op12_html_extraction
from dossier.llm.lm_scoring import op1_lm_scoring
from dossier.llm.mixing import OP8_SQL, op8_mixing
from dossier.llm.pii import op9_pii
from dossier.llm.quality import op4_quality
from dossier.llm.toxicity import op7_toxicity
from dossier.llm.url_rules import OP2_SQL, op2_url_filters
from dossier.llm.vector_dedup import OP3_SQL, op3_vector_dedup
from dossier.llm.warc import OP6_SQL, op6_warc

QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_url_filters": op2_url_filters,
    "op3_vector_dedup": op3_vector_dedup,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_html_extraction": op12_html_extraction,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES: dict[str, str] = {
    "op2_url_filters": OP2_SQL,
    "op3_vector_dedup": OP3_SQL,
    "op5_decontaminate": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_mixing": OP8_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
