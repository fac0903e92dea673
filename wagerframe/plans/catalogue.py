"""All registered queries and their SQL twins."""

from __future__ import annotations

from wagerframe.plans import (  # noqa: F401  (imported for registration)
    generation_queries,
    option_queries,
    pair_queries,
    policy_queries,
    sampling_queries,
    source_queries,
    streaming_queries,
    text_queries,
)
from wagerframe.plans.registry import QUERIES, TWINS


def queries() -> dict:
    return dict(QUERIES)


def twins() -> dict:
    return dict(TWINS)
