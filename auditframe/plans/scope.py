"""Which columns a rule applies to."""

from __future__ import annotations

import re
from fnmatch import translate

from ..models import RuleConfig
from ..sources.catalog import Table


def glob_matches(name: str | None, pattern: str | None) -> bool:
    """Case-insensitive ``*``, ``?``, ``[seq]``; no pattern matches everything, no name is an empty one."""
    return not pattern or re.match(translate(pattern.lower()), (name or "").lower()) is not None


def in_scope(rule: RuleConfig, schema_name: str | None, table_name: str, column_name: str | None) -> bool:
    s = rule.scope
    return glob_matches(schema_name, s.schema_pattern) and glob_matches(table_name, s.table_pattern) and (column_name is None or glob_matches(column_name, s.column_pattern))


def targets(rules: list[RuleConfig], tables: list[Table]) -> list[tuple[RuleConfig, Table, str]]:
    return [(r, t, c) for r in rules for t in tables for c, _, _ in t.columns if in_scope(r, t.schema_name, t.table_name, c)]
