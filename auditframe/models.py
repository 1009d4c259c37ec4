"""Configurations and row schemas; all validated on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

SEVERITIES = ("info", "warning", "error", "critical")
RUN_STATUS = ("success", "failed", "partial")

_s, _l, _d, _b, _t = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


PROFILE = _schema(schema_name=_s, table_name=_s, column_name=_s, data_type=_s, nullable=_b, row_count=_l, null_count=_l)
METRIC = _schema(run_id=_s, schema_name=_s, table_name=_s, column_name=_s, dimension=_s, score=_d, value=_d, metadata=_s)
ISSUE = _schema(issue_id=_s, run_id=_s, schema_name=_s, table_name=_s, column_name=_s, dimension=_s, severity=_s, message=_s, evidence=_s, rule_name=_s)
TARGET = _schema(rule_name=_s, dimension=_s, severity=_s, kind=_s, schema_name=_s, table_name=_s, column_name=_s, total_rows=_l, violations=_l, status=_s, detail=_s)
RULE_RUN = _schema(run_id=_s, rule_name=_s, targets_checked=_l, targets_failed=_l, targets_error=_l)
RUN = _schema(run_id=_s, connection_id=_s, started_at=_t, ended_at=_t, status=_s)
CHANGE = _schema(run_id=_s, operation=_s, schema_name=_s, table_name=_s, column_name=_s, row_key=_s, before_value=_s, after_value=_s)


class RowCeilingError(RuntimeError):
    """A cleansing run would change more rows than it may."""


class ReadOnlyError(RuntimeError):
    """A writing operation was asked of a read-only connection."""


def _checked(model: type, data: dict[str, Any]) -> Any:
    """A model from a mapping; names it doesn't know are ignored."""
    known = {f.name for f in fields(model)}
    return model(**{k: v for k, v in data.items() if k in known})


@dataclass(frozen=True)
class ConnectionConfig:
    id: str
    dsn: str
    read_only: bool = False
    options: dict[str, Any] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if not isinstance(self.dsn, str) or not self.dsn.strip():
            raise ValueError("dsn is empty")
        object.__setattr__(self, "dsn", self.dsn.strip())

    from_mapping = classmethod(_checked)


@dataclass(frozen=True)
class SamplingConfig:
    """``first_n``: the first rows by the keys; ``random``: those of least hash of keys and seed."""

    method: str = "random"
    limit: int = 1000
    seed: int = 0
    keys: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.method not in ("random", "first_n"):
            raise ValueError(f"unknown sampling method {self.method!r}")
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or self.limit < 1:
            raise ValueError("the limit of a sample isn't a positive number")

    from_mapping = classmethod(_checked)


@dataclass(frozen=True)
class PipelineConfig:
    connection_id: str = "default"
    include_schemas: list[str] = field(default_factory=list)
    exclude_schemas: list[str] = field(default_factory=list)
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    rule_files: list[str] = field(default_factory=list)
    metric_thresholds: dict[str, float] | None = None
    sampling: SamplingConfig | None = None

    def __post_init__(self) -> None:
        for what in ("schemas", "tables"):
            both = set(getattr(self, f"include_{what}")) & set(getattr(self, f"exclude_{what}"))
            if both:
                raise ValueError(f"{what} both included and excluded: {sorted(both)}")
        if isinstance(self.sampling, dict):
            object.__setattr__(self, "sampling", SamplingConfig.from_mapping(self.sampling))
        for name, at in (self.metric_thresholds or {}).items():
            if isinstance(at, bool) or not isinstance(at, int | float) or not 0 <= at <= 1:
                raise ValueError(f"threshold of {name} isn't within 0 and 1")

    from_mapping = classmethod(_checked)


@dataclass(frozen=True)
class RuleScope:
    schema_pattern: str | None = None
    table_pattern: str | None = None
    column_pattern: str | None = None

    from_mapping = classmethod(_checked)


@dataclass(frozen=True)
class RuleConfig:
    name: str
    expression: str
    dimension: str = "validity"
    severity: str = "warning"
    scope: RuleScope = field(default_factory=RuleScope)
    params: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name.strip() or " " in self.name:
            raise ValueError("a rule's name is non-empty and has no blank")
        if not isinstance(self.expression, str) or not self.expression.strip():
            raise ValueError(f"rule {self.name} has no expression")
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity {self.severity!r} isn't one of {', '.join(SEVERITIES)}")
        for bound in ("min", "max"):
            value = self.params.get(bound)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int | float)):
                raise ValueError(f"{bound} of rule {self.name} isn't a number")
        if isinstance(self.scope, dict):
            object.__setattr__(self, "scope", RuleScope.from_mapping(self.scope))

    @property
    def kind(self) -> str:
        return self.expression.strip().upper()

    from_mapping = classmethod(_checked)


@dataclass(frozen=True)
class CleansingConfig:
    operation: str
    table_name: str
    schema_name: str | None = None
    column_name: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True

    from_mapping = classmethod(_checked)
