"""Settings of the process and options of a repository, from TOML files, the environment and defaults."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

from .sources.ignore import DEFAULTS

NAME = "nodelake"


def _xdg(variable: str, otherwise: str) -> Path:
    return Path(os.environ.get(variable) or Path.home() / otherwise) / NAME


def config_dir() -> Path:
    return _xdg("XDG_CONFIG_HOME", ".config")


def data_dir() -> Path:
    return _xdg("XDG_DATA_HOME", ".local/share")


def cache_dir() -> Path:
    return _xdg("XDG_CACHE_HOME", ".cache")


def _value(text: str) -> Any:
    try:
        return tomllib.loads(f"x = {text}")["x"]
    except tomllib.TOMLDecodeError:
        return text


def to_toml(values: dict[str, Any]) -> str:
    """Scalars and lists first, then tables."""
    def one(v: Any) -> str:
        return "[" + ", ".join(map(one, v)) + "]" if isinstance(v, (list, tuple)) else json.dumps(v, ensure_ascii=False)

    flat = [f"{k} = {one(v)}" for k, v in values.items() if not isinstance(v, dict) and v is not None]
    tables = [f"\n[{k}]\n" + to_toml(v).rstrip("\n") for k, v in values.items() if isinstance(v, dict)]
    return "\n".join([*flat, *tables]) + "\n"


@dataclass(frozen=True)
class RepoOptions:
    """Options of one repository: from its own file, else its section in pyproject.toml, else defaults. A file of its own
    that can't be read gives the defaults."""

    collection: str | None = None
    ignore_patterns: list[str] = field(default_factory=list)
    max_file_size: int = 10 * 1024 * 1024
    max_sync_files: int = 500
    upsert_batch_size: int = 100

    FILE = f".{NAME}.toml"

    @classmethod
    def _from(cls, values: dict[str, Any]) -> RepoOptions:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    @classmethod
    def from_repo(cls, root: str | Path) -> RepoOptions:
        own, project = Path(root, cls.FILE), Path(root, "pyproject.toml")
        for path, section in ((own, None), (project, NAME)):
            if path.exists():
                try:
                    values = tomllib.loads(path.read_text())
                    values = values if section is None else values.get("tool", {}).get(section)
                except (OSError, ValueError):
                    values = {} if section is None else None
                if values is not None:
                    return cls._from(values)
        return cls()

    def save(self, root: str | Path) -> Path:
        path = Path(root, self.FILE)
        path.write_text(to_toml(asdict(self)))
        return path

    @classmethod
    def set_value(cls, root: str | Path, key: str, value: str) -> RepoOptions:
        if key not in {f.name for f in fields(cls)}:
            raise KeyError(key)
        out = replace(cls.from_repo(root), **{key: _value(value)})
        out.save(root)
        return out


@dataclass(frozen=True)
class Settings:
    """``NODELAKE_<NAME>`` (``NODELAKE_STORE__PATH`` for a field of a section) overrides the file; the file, the defaults."""

    ignore_patterns: list[str] = field(default_factory=lambda: list(DEFAULTS))
    store: dict[str, Any] = field(default_factory=lambda: {"mode": "local", "path": str(data_dir() / "store")})
    embedding: dict[str, Any] = field(default_factory=lambda: {"model_name": "hashed"})
    server: dict[str, Any] = field(default_factory=lambda: {"host": "127.0.0.1", "port": 8765, "default_top_k": 10})

    @classmethod
    def load(cls) -> Settings:
        values = asdict(cls())
        path = config_dir() / "config.toml"
        if path.exists():
            try:
                for k, v in tomllib.loads(path.read_text()).items():
                    if k in values:
                        values[k] = values[k] | v if isinstance(v, dict) else v
            except (OSError, ValueError):
                pass
        for k, v in os.environ.items():
            section, _, key = k.removeprefix(f"{NAME.upper()}_").lower().partition("__")
            if k.startswith(f"{NAME.upper()}_") and section in values:
                if key:
                    values[section] = values[section] | {key: _value(v)}
                else:
                    values[section] = _value(v)
        if values["store"].get("mode") not in ("local", "memory", "remote"):
            raise ValueError(f"unknown store mode {values['store'].get('mode')!r}")
        return cls(**values)

    def save(self) -> Path:
        path = config_dir() / "config.toml"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(to_toml(asdict(self)))
        return path
