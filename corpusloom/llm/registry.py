"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import OP9_SQL, op9_chat
from .decontaminate import op5_decontaminate
from .infill import OP11_SQL, op11_fim
from .langid import op2_langid
from .lm import op4_lm
from .media import op10_media
from .packing import op6_packing
from .quality import op7_quality
from .resample import OP12_SQL, op12_resample
from .simhash import op3_simhash
from .token_store import op8_token_store
from .toxicity import op1_toxicity
from .warc import OP13_SQL, op13_warc

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_langid, op3_simhash, op4_lm, op5_decontaminate, op6_packing, op7_quality, op8_token_store, op9_chat, op10_media, op11_fim, op12_resample, op13_warc)}
SQL = {"op9_chat": OP9_SQL, "op11_fim": OP11_SQL, "op12_resample": OP12_SQL, "op13_warc": OP13_SQL}
