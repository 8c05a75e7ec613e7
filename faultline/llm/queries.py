"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .conversation_trie import OP12_SQL, op12_conversation_trie
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .language_id import op8_language_id
from .line_dedup import OP11_SQL, op11_line_dedup
from .lexical_search import OP13_SQL, op13_lexical_search
from .mixing import OP1_SQL, op1_mix_sources
from .ngram_join import op7_ngram_join
from .packing import op4_packing
from .quality import op3_quality
from .suffix_dedup import op5_suffix_dedup
from .token_file import op6_token_files
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_ngram_join": op7_ngram_join,
    "op8_language_id": op8_language_id,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_lexical_search": op13_lexical_search,
}
SQL = {"op1_mix_sources": OP1_SQL, "op2_warc": OP2_SQL, "op9_url_filter": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_line_dedup": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_lexical_search": OP13_SQL}
