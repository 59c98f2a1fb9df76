"""All modules with queries, imported once; each registers its own."""

from daygrid.llm import (  # noqa: F401
    alignment, bpe, chat, decontamination, divergence, licenses, near_duplicates, pii, pivots, quality_rules, repeats, sharding, warc,
)
from daygrid.llm.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
