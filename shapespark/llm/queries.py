"""The queries of this package and their SQL."""

from __future__ import annotations

from . import sql
from .chat import op6_chat_format
from .decontaminate import op3_decontaminate
from .html_text import op10_html_text
from .piece_bpe import op5_sentencepiece
from .quality import op7_quality_rules
from .secrets import op1_secret_scan
from .simhash import op4_simhash
from .tokenpack import op2_token_pack
from .toxicity import op9_toxicity
from .warc import op8_warc

QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_pack, op3_decontaminate, op4_simhash, op5_sentencepiece, op6_chat_format, op7_quality_rules, op8_warc, op9_toxicity, op10_html_text)}
ORACLES = sql.ORACLES
