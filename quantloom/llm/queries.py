"""The queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from .bpe import op2_bpe
from .chat import SQL as CHAT_SQL
from .chat import op5_chat
from .html_extract import op4_html
from .langid import op6_langid
from .nndescent import op10_embeddings
from .packing import op1_packing
from .secrets import op9_secrets
from .simhash import op8_simhash
from .topk import SQL as TOPK_SQL
from .topk import op3_topk
from .warc import SQL as WARC_SQL
from .warc import op7_warc


def queries() -> dict:
    return {"op1_packing": op1_packing, "op2_bpe": op2_bpe, "op3_topk": op3_topk, "op4_html": op4_html, "op5_chat": op5_chat, "op6_langid": op6_langid, "op7_warc": op7_warc, "op8_simhash": op8_simhash, "op9_secrets": op9_secrets, "op10_embeddings": op10_embeddings}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": TOPK_SQL, "op5_chat": CHAT_SQL, "op7_warc": WARC_SQL}
