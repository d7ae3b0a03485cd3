"""Masking policies: which columns are masked, how, and for which families."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..families import chosen
from ..functions import MODES, mask_pii

_VARIABLE = re.compile("[$]{(.+?)}")


def _filled(value: Any) -> Any:
    """``${NAME}`` in any string becomes the environment's value; one that isn't set is a KeyError."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ[m[1]], value)
    if isinstance(value, dict):
        return {k: _filled(v) for k, v in value.items()}
    return [_filled(v) for v in value] if isinstance(value, list) else value


class Policy:
    """Rules by column: ``{"mode": ..., "patterns": [...], "salt": ...}``, all optional."""

    def __init__(self, columns: dict[str, dict[str, Any]]) -> None:
        self.rules: dict[str, dict[str, Any]] = {}
        for name, rule in columns.items():
            mode, salt, patterns = rule.get("mode", "asterisk"), rule.get("salt"), rule.get("patterns") or None
            if mode not in MODES:
                raise ValueError(f"column {name!r}: unknown mode {mode!r}, valid modes: {', '.join(MODES)}")
            if mode == "consistent" and not salt:
                raise ValueError(f"column {name!r}: mode 'consistent' needs a salt")
            chosen(patterns)
            self.rules[name] = {"mode": mode, "patterns": patterns, "salt": salt if mode == "consistent" else None}

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> Policy:
        columns = data["columns"] if "columns" in data else {}
        if isinstance(columns, list) or not hasattr(columns, "items"):
            raise ValueError("'columns' must map column names to rules")
        return cls(_filled(columns))

    def apply(self, df: DataFrame) -> DataFrame:
        """``df`` with the columns masked, all in one projection."""
        missing = [c for c in self.rules if c not in df.columns]
        if missing:
            raise ValueError(f"columns that the data doesn't have: {', '.join(missing)}")
        return df.withColumns({c: mask_pii(c, **rule) for c, rule in self.rules.items()}) if self.rules else df


def load_policy(path: str | Path) -> Policy:
    """A policy from a ``.yaml``, ``.yml`` or ``.toml`` file."""
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no policy file {path}")
    kind = path.suffix.lower()
    if kind in (".yaml", ".yml"):
        import yaml

        return Policy.from_dict(yaml.safe_load(path.read_text(encoding="utf-8")) or {})
    if kind == ".toml":
        data = tomllib.loads(path.read_text(encoding="utf-8"))
        if isinstance(data.get("columns"), list):
            data["columns"] = {rule["name"]: {k: v for k, v in rule.items() if k != "name"} for rule in data["columns"]}
        return Policy.from_dict(data)
    raise ValueError(f"unsupported policy format {kind!r}, use .yaml, .yml or .toml")
