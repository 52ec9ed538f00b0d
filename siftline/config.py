"""Configuration: YAML files of limits, policies, prompt rules and the detector registry, checked field by field.

The root is the folder given, else ``SIFTLINE_CONFIG_ROOT``, else the package's own ``config/``. A file
given as an override is merged into the defaults, mapping by mapping; then the environment counts
(``SIFTLINE_DATA_DIR``, ``SIFTLINE_OFFLINE_STRICT``, ``SIFTLINE_STORAGE_MAX_BYTES``). Everything here is read
once on the driver; what it yields goes into plans as literals.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any, NamedTuple

import yaml

from .operators import policy
from .schemas import CATEGORIES, PROFILES

PACKAGED = Path(__file__).resolve().parent / "config"
SEVERITIES = ("low", "medium", "high", "critical")
_KINDS = {bool: "boolean", int: "integer", str: "string", float: "number"}


class ConfigurationError(ValueError):
    """A configuration that is missing or breaks its schema."""


def _read(path: Path) -> dict[str, Any]:
    if not path.is_file():
        raise ConfigurationError(f"missing configuration file: {path}")
    try:
        got = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    except yaml.YAMLError as error:
        raise ConfigurationError(f"{path}: {error}") from error
    if not isinstance(got, dict):
        raise ConfigurationError(f"{path}: a mapping is expected")
    return got


def root(given: str | Path | None = None, env: Mapping[str, str] = os.environ) -> Path:
    at = Path(given or env.get("SIFTLINE_CONFIG_ROOT") or PACKAGED).resolve()
    for needed in ("default.yaml", "policies", "prompt_rules", "detector_registry.yaml"):
        if not (at / needed).exists():
            raise ConfigurationError(f"{at} lacks {needed}")
    return at


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """``over`` on top of ``base``; mappings are merged, everything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def _check(value: Any, pattern: Any, at: str) -> None:
    """``value`` has the fields and kinds of ``pattern`` (the default configuration), and positive numbers where its are."""
    if isinstance(pattern, dict):
        if not isinstance(value, dict) or set(value) - set(pattern):
            raise ConfigurationError(f"{at or 'configuration'}: unknown or misplaced fields {sorted(set(value) - set(pattern)) if isinstance(value, dict) else value!r}")
        for key in value:
            _check(value[key], pattern[key], f"{at}.{key}".lstrip("."))
        return
    kinds = (int, float) if isinstance(pattern, float) else (type(pattern),)
    if pattern is not None and (not isinstance(value, kinds) or isinstance(value, bool) != isinstance(pattern, bool)):
        raise ConfigurationError(f"{at}: a {_KINDS[type(pattern)]} is expected, not {value!r}")
    if isinstance(pattern, (int, float)) and not isinstance(pattern, bool) and (value < 0 or value == 0 and pattern > 0 and not at.endswith(("depth", "objects", "grace_period_seconds"))):
        raise ConfigurationError(f"{at}: {value} isn't positive")


def load(override: str | Path | None = None, config_root: str | Path | None = None, env: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """The whole configuration, merged and checked."""
    pattern = _read(PACKAGED / "default.yaml")
    got = merge(pattern, _read(root(config_root, env) / "default.yaml"))
    if override:
        got = merge(got, _read(Path(override)))
    if env.get("SIFTLINE_DATA_DIR"):
        got["data_dir"] = env["SIFTLINE_DATA_DIR"]
    if env.get("SIFTLINE_OFFLINE_STRICT"):
        got = merge(got, {"offline": {"strict": env["SIFTLINE_OFFLINE_STRICT"].lower() in ("1", "true", "yes")}})
    if env.get("SIFTLINE_STORAGE_MAX_BYTES"):
        try:
            got = merge(got, {"storage": {"maximum_total_store_bytes": int(env["SIFTLINE_STORAGE_MAX_BYTES"])}})
        except ValueError as error:
            raise ConfigurationError(f"SIFTLINE_STORAGE_MAX_BYTES: {error}") from error
    _check(got, pattern, "")
    return got


def config_hash(config: dict[str, Any]) -> str:
    """The same for the same values, in whatever order they stand."""
    return "sha256:" + hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


# ---------------------------------------------------------------- policies, registry, rules
def _fields(row: Any, needed: set[str], allowed: set[str], at: str) -> dict:
    if not isinstance(row, dict) or not needed <= set(row) or set(row) - needed - allowed:
        raise ConfigurationError(f"{at}: fields {sorted(needed)} are needed, {sorted(allowed)} allowed")
    return row


def load_policy(path: str | Path, profile: str | None = None) -> policy.Policy:
    """One policy; ``profile`` is the one that the file must be for."""
    got = _fields(_read(Path(path)), {"profile", "default_action", "rules"}, {"default_summary"}, str(path))
    if profile and got["profile"] != profile:
        raise ConfigurationError(f"{path} is for {got['profile']}, not {profile}")
    rules = []
    for row in got["rules"] or []:
        row = _fields(row, {"id", "action", "when"}, {"priority", "summary"}, str(path))
        when = {("at_least" if k == "greater_than_or_equal" else k): v for k, v in (row["when"] or {}).items()}
        rules.append(policy.Rule(row["id"], int(row.get("priority", 0)), row["action"], when))
    try:
        return policy.check(policy.Policy(got["profile"], got["default_action"], rules))
    except policy.PolicyError as error:
        raise ConfigurationError(f"{path}: {error}") from error


def load_policies(config_root: str | Path | None = None, env: Mapping[str, str] = os.environ) -> dict[str, policy.Policy]:
    """The policies of all profiles, from the files named after them."""
    at = root(config_root, env) / "policies"
    return {p: load_policy(at / f"{p.lower().replace('_', '-')}.yaml", p) for p in PROFILES}


def load_registry(config_root: str | Path | None = None, env: Mapping[str, str] = os.environ) -> list[tuple[str, str, str, bool, list[str]]]:
    """Detectors (id, family, category, required, profiles that require it too)."""
    path = root(config_root, env) / "detector_registry.yaml"
    out = []
    for row in _fields(_read(path), {"detectors"}, set(), str(path))["detectors"]:
        row = _fields(row, {"id", "family", "category"}, {"required", "required_profiles"}, str(path))
        profiles = row.get("required_profiles") or []
        if row["category"] not in CATEGORIES or set(profiles) - set(PROFILES):
            raise ConfigurationError(f"{path}: {row['id']}: unknown category or profile")
        out.append((row["id"], row["family"], row["category"], bool(row.get("required", False)), profiles))
    if len({r[0] for r in out}) != len(out):
        raise ConfigurationError(f"{path}: a detector id is repeated")
    return out


class PromptRule(NamedTuple):
    id: str
    category: str
    severity: str
    patterns: list[str]


def load_rules(config_root: str | Path | None = None, env: Mapping[str, str] = os.environ) -> list[PromptRule]:
    """The prompt rules of ``generic.yaml``, then of the other files by name."""
    at = root(config_root, env) / "prompt_rules"
    out: list[PromptRule] = []
    for path in sorted(at.glob("*.yaml"), key=lambda p: (p.stem != "generic", p.stem)):
        for row in _fields(_read(path), {"rules"}, set(), str(path))["rules"]:
            row = _fields(row, {"id", "category", "patterns"}, {"severity", "languages"}, str(path))
            if not row["patterns"] or row.get("languages") == [] or row.get("severity", "medium") not in SEVERITIES:
                raise ConfigurationError(f"{path}: {row['id']}: no patterns, no languages or an unknown severity")
            for x in row["patterns"]:
                try:
                    re.compile(x)
                except re.error as error:
                    raise ConfigurationError(f"{path}: {row['id']}: {error}") from error
            out.append(PromptRule(row["id"], row["category"], row.get("severity", "medium"), list(row["patterns"])))
    if len({r.id for r in out}) != len(out):
        raise ConfigurationError(f"{at}: a rule id is repeated")
    return out
