"""YAML and JSON configuration files."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path
from typing import Any

from .models import ConnectionConfig, PipelineConfig, RuleConfig

_VARIABLE = re.compile(r"\$\{(\w+)\}")


def read_mapping(path: str | Path) -> dict[str, Any]:
    """The mapping in a file: YAML for .yaml and .yml, else JSON."""
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("PyYAML is needed for YAML files; JSON files need nothing") from e
        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path}: the top level isn't a mapping")
    return data


def expand_env(value: Any) -> Any:
    """``${NAME}`` in every string replaced by the environment's value; unset names stay as they are."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), value)
    if isinstance(value, list):
        return [expand_env(x) for x in value]
    if isinstance(value, dict):
        return {k: expand_env(x) for k, x in value.items()}
    return value


def _load(model: type, data: Any, path: str | Path) -> Any:
    try:
        return model.from_mapping(data)
    except (TypeError, ValueError, AttributeError) as e:
        raise ValueError(f"Validation failed for {path}: {e}") from e


def load_connection(path: str | Path) -> ConnectionConfig:
    return _load(ConnectionConfig, expand_env(read_mapping(path)), path)


def load_pipeline(path: str | Path) -> PipelineConfig:
    return _load(PipelineConfig, expand_env(read_mapping(path)), path)


def load_rules(path: str | Path) -> list[RuleConfig]:
    rules = expand_env(read_mapping(path)).get("rules", [])
    if not isinstance(rules, list) or not all(isinstance(r, dict) for r in rules):
        raise ValueError(f"{path}: rules isn't a list of mappings")
    return [_load(RuleConfig, r, path) for r in rules]


def load_rules_from_files(paths: list[str | Path]) -> list[RuleConfig]:
    """Rules of all files; a later one of the same name takes the earlier one's place."""
    merged: dict[str, RuleConfig] = {}
    for path in paths:
        merged |= {r.name: r for r in load_rules(path)}
    return list(merged.values())
