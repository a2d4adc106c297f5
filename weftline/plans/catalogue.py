"""All table queries by name, with their SQL."""

from __future__ import annotations

from weftline.plans import q_clean, q_compare, q_files, q_keys, q_lifecycle, q_metadata, q_profile, q_repair, q_rules, q_shape  # noqa: F401
from weftline.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
