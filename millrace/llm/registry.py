"""Queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import alignment, bpe, licenses, line_dedup, merkle, neighbours, packing, pii, quality, rules, simhash, suffix_dedup, toxicity


def queries() -> dict:
    found = {}
    for module in (alignment, bpe, licenses, line_dedup, merkle, neighbours, packing, pii, quality, rules, simhash, suffix_dedup, toxicity):
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2].isdigit()}
    return found


def oracle_sql() -> dict[str, str]:
    return line_dedup.SQL | merkle.SQL
