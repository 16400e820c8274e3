"""All queries of this subpackage; importing it registers them."""

from nightledger.llm import (  # noqa: F401
    audit,
    bpe,
    bytes_dedup,
    exact,
    fim,
    html,
    jaccard,
    mixing,
    pii,
    quality,
    sharding,
    warc,
    words_dedup,
)
from nightledger.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
