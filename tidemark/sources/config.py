"""Configurations from YAML or JSON with inheritance."""

from __future__ import annotations

import hashlib
import json
import os


class ConfigError(ValueError):
    pass


def _load(path: str) -> dict:
    with open(path) as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("reading YAML needs PyYAML; JSON works without") from e
        return yaml.safe_load(f) or {}


def merge(base: dict, over: dict) -> dict:
    """`over` on top of `base`, map by map; lists and scalars are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, seen: tuple[str, ...] = ()) -> dict:
    """A file and those it inherits from, nearest last."""
    path = os.path.abspath(path)
    if path in seen:
        raise ConfigError("inheritance runs in a circle: " + " -> ".join((*seen, path)))
    own = _load(path)
    parent = own.pop("inherits", None)
    return merge(load(os.path.join(os.path.dirname(path), parent), (*seen, path)), own) if parent else own


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()
