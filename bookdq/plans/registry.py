"""Check registry and configuration: built-in checks and plug-ins register a function (book, config) -> CheckResult."""
from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from types import UnionType
from typing import Any, Union, get_args, get_origin, get_type_hints

from pyspark.sql import DataFrame


@dataclass
class CheckResult:
    findings: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CheckEntry:
    name: str
    run: Callable[[Any, Any], CheckResult]
    config: type
    title: str
    order: int
    category: str


_ENTRIES: dict[str, CheckEntry] = {}
_BUILT_IN = ("keys", "rules", "missing", "values", "distribution", "mix", "targets")


def check(name: str, config: type, title: str, order: int, category: str = "Checks"):
    """Register a check under a unique name."""
    def add(run):
        if name in _ENTRIES and _ENTRIES[name].run is not run:
            raise ValueError(f"check {name!r} is registered twice")
        _ENTRIES[name] = CheckEntry(name, run, config, title, order, category)
        return run

    return add


def checks(plugins: Iterable[str] = ()) -> dict[str, CheckEntry]:
    """Every check in run order; `plugins` are modules that register more."""
    for module in (*[f"bookdq.operators.{m}" for m in _BUILT_IN], *plugins):
        importlib.import_module(module)
    return dict(sorted(_ENTRIES.items(), key=lambda e: (e[1].order, e[0])))


def deep_merge(base: Mapping, override: Mapping) -> dict:
    """Nested dictionaries merged key by key, the override winning."""
    out = dict(base)
    for key, value in override.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = deep_merge(out[key], value) if both else value
    return out


def from_dict(cls: type, data: Mapping) -> Any:
    """A (nested) config dataclass from plain data; a key the class does not have is an error."""
    hints = get_type_hints(cls)
    known = {f.name for f in fields(cls)}
    extra = set(data) - known
    if extra:
        raise ValueError(f"{cls.__name__}: unknown setting(s) {', '.join(sorted(map(str, extra)))}")
    return cls(**{k: _convert(hints[k], v) for k, v in data.items()})


def _convert(hint: Any, value: Any) -> Any:
    """A plain value in the shape its type hint asks for: dataclass, mapping of them, tuple of them, or as it is."""
    options = [hint, *get_args(hint)] if get_origin(hint) in (Union, UnionType) else [hint]
    for option in options:
        args = get_args(option)
        if isinstance(value, Mapping):
            if is_dataclass(option):
                return from_dict(option, value)
            if len(args) == 2 and get_origin(option) in (dict, Mapping):
                return {k: _convert(args[1], v) for k, v in value.items()}
        if isinstance(value, (list, tuple)) and get_origin(option) is tuple:
            return tuple(_convert(args[0], v) for v in value)
    return value


def check_config(entry: CheckEntry, settings: Mapping | None = None, overrides: Mapping | None = None) -> Any:
    """The check's settings with the profile's overrides merged over them."""
    return from_dict(entry.config, deep_merge(settings or {}, overrides or {}))
