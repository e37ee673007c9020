"""All queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import (chat, codes, decontaminate, language, mixing, packing, pii, quality, simhash, topk,
               urlfilter, warc, whitening)

_MODULES = [quality, pii, mixing, decontaminate, packing, simhash, language, topk, urlfilter, warc,
            whitening, chat, codes]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE", {}).items()}
