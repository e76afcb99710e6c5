"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from panelspark.llm import align, bpe, codes, exact, jaccard, langid, licenses, lm, mixing, neardup, quality, secrets, suffixes

MODULES = (jaccard, bpe, neardup, mixing, secrets, lm, suffixes, langid, licenses, quality, exact, align, codes)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
