"""All registered queries."""

from __future__ import annotations

from credence.plans import corpus_queries, listing_queries, rule_queries, text_queries

_PARTS = [listing_queries, text_queries, rule_queries, corpus_queries]


def all_queries():
    return {name: fn for part in _PARTS for name, fn in part.R.queries.items()}


def all_oracles():
    return {name: sql for part in _PARTS for name, sql in part.R.oracles.items()}
