"""Settings: nested mappings from YAML or JSON, with inheritance and dotted access."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any


def merged(below: Mapping, above: Mapping) -> dict:
    """above laid over below; mappings merge, all else is replaced."""
    out = dict(below)
    for k, v in above.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def _read(path: Path) -> dict:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def load(path: str | Path, overrides: Mapping[str, Any] | None = None, base_key: str = "_base") -> Settings:
    """A file laid over its `_base` (a path beside it), that over its own, and so on; a circle is an error. overrides have dotted keys."""
    chain, path = [], Path(path).resolve()
    while path is not None:
        if path in (p for p, _ in chain):
            raise ValueError(f"settings inherit from themselves: {path}")
        data = _read(path)
        base = data.pop(base_key, None)
        chain.append((path, data))
        path = (path.parent / base).resolve() if base else None
    out: dict = {}
    for _, data in reversed(chain):
        out = merged(out, data)
    for key, value in (overrides or {}).items():
        for part in reversed(key.split(".")):
            value = {part: value}
        out = merged(out, value)
    return Settings(out)


class Settings(Mapping):
    """A nested mapping read by dotted keys."""

    def __init__(self, data: Mapping) -> None:
        self._data = dict(data)

    def __getitem__(self, key: str) -> Any:
        found: Any = self._data
        for part in key.split("."):
            if not isinstance(found, Mapping) or part not in found:
                raise KeyError(key)
            found = found[part]
        return found

    def __iter__(self) -> Iterator[str]:
        return iter(self._data)

    def __len__(self) -> int:
        return len(self._data)

    def as_dict(self) -> dict:
        return merged({}, self._data)
