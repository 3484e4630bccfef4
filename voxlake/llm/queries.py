"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_format
from .langid import op6_crf_language
from .mixing import op1_source_mix
from .mpeg_audio import op4_mpeg_audio
from .neardup import op10_minhash_neardup
from .packing import op3_mixture_packing
from .search import OP9_SQL, op9_bm25_search
from .secret_scan import op5_secret_automata
from .token_store import op7_content_store
from .warc import OP8_SQL, op8_warc_derivatives

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_chat_format": op2_chat_format,
    "op3_mixture_packing": op3_mixture_packing,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_secret_automata": op5_secret_automata,
    "op6_crf_language": op6_crf_language,
    "op7_content_store": op7_content_store,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_bm25_search": op9_bm25_search,
    "op10_minhash_neardup": op10_minhash_neardup,
}
SQL = {"op2_chat_format": OP2_SQL, "op8_warc_derivatives": OP8_SQL, "op9_bm25_search": OP9_SQL}
