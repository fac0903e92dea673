"""All queries of this subpackage."""

from __future__ import annotations

from wagerframe.llm import (  # noqa: F401  (imported for registration)
    collocations,
    exact_dedup,
    language,
    mixing,
    near_dedup,
    packing,
    quality,
    resampling,
    sharding,
    token_counts,
    toxicity,
    vector_search,
    warc,
)
from wagerframe.llm.registry import QUERIES, TWINS


def queries() -> dict:
    return dict(QUERIES)


def twins() -> dict:
    return dict(TWINS)
