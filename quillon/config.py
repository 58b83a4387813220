"""Settings from quillon.toml or [tool.quillon] of pyproject.toml, searched upwards, under those from the environment."""

from __future__ import annotations

import logging
import os
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

log = logging.getLogger(__name__)


@dataclass
class IndexSettings:
    persist_dir: str = "./quillon_db"
    collection: str = "documents"
    model: str = "hashing-64"
    batch_size: int = 64
    chunk_size: int = 512
    chunk_overlap: int = 64
    glob: str = "**/*.txt"


@dataclass
class SearchSettings:
    top_k: int = 5
    rerank: bool = False
    rerank_model: str = "lexical"
    hybrid: bool = False
    alpha: float = 0.5


@dataclass
class ServerSettings:
    host: str = "127.0.0.1"
    port: int = 8484
    api_key: str = ""
    cors_origin: str = ""

    def __setattr__(self, name, value):
        if name == "port" and not 0 <= value <= 65535:
            raise ValueError(f"port {value} is not in 0..65535")
        super().__setattr__(name, value)


@dataclass
class WatchSettings:
    extensions: list[str] = field(default_factory=lambda: [".txt", ".md", ".py"])


@dataclass
class Settings:
    index: IndexSettings = field(default_factory=IndexSettings)
    search: SearchSettings = field(default_factory=SearchSettings)
    server: ServerSettings = field(default_factory=ServerSettings)
    watch: WatchSettings = field(default_factory=WatchSettings)


#: Environment variable to section and key.
ENVIRONMENT = {
    "QUILLON_DB": ("index", "persist_dir"),
    "QUILLON_COLLECTION": ("index", "collection"),
    "QUILLON_MODEL": ("index", "model"),
    "QUILLON_TOP_K": ("search", "top_k"),
    "QUILLON_HOST": ("server", "host"),
    "QUILLON_PORT": ("server", "port"),
    "QUILLON_API_KEY": ("server", "api_key"),
}


def _found(start: Path) -> dict:
    for folder in (start, *start.parents):
        own, project = folder / "quillon.toml", folder / "pyproject.toml"
        if own.is_file():
            return tomllib.loads(own.read_text("utf-8"))
        if project.is_file() and "quillon" in (tool := tomllib.loads(project.read_text("utf-8")).get("tool", {})):
            return tool["quillon"]
    return {}


def load_settings(folder: str | None = None) -> Settings:
    """Unknown keys and unusable values are left out with a warning; the environment wins, also without a file."""
    out = Settings()

    def put(section: str, key: str, value) -> None:
        part = getattr(out, section, None)
        key = key.replace("-", "_")
        if part is None or key not in {f.name for f in fields(part)}:
            log.warning("unknown setting %s.%s", section, key)
            return
        try:
            kind = type(getattr(part, key))
            setattr(part, key, kind(value) if kind in (int, float, str) and not isinstance(value, kind) else value)
        except (TypeError, ValueError) as e:
            log.warning("setting %s.%s: %s", section, key, e)

    for section, values in _found(Path(folder or ".").resolve()).items():
        if isinstance(values, dict):
            for key, value in values.items():
                put(section, key, value)
        elif section == "watch_extensions":
            put("watch", "extensions", values)
        else:
            log.warning("unknown setting %s", section)
    for name, (section, key) in ENVIRONMENT.items():
        if name in os.environ:
            put(section, key, os.environ[name])
    return out
