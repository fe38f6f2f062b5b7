"""Configuration: defaults, a small YAML file, and what callers pass, in rising order of precedence."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

FILE_NAME = "config.yaml"
DEFAULT_HOME = "~/.codeatlas"
#: Of a fresh configuration (fixed values).
DEFAULT_MODEL, DEFAULT_BATCH, DEFAULT_TOP_K = "mock", 32, 5


def blank_to_none(value: Any) -> str | None:
    text = "" if value is None else str(value).strip()
    return text or None


def to_int(value: Any) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return int(value) if isinstance(value, (int, float)) else int(str(value).strip())
    except ValueError:
        return None


@dataclass(frozen=True)
class Embedding:
    model: str = DEFAULT_MODEL
    model_name: str = DEFAULT_MODEL
    dimension: int | None = None
    model_path: str | None = None
    api_key: str | None = None
    batch_size: int = DEFAULT_BATCH


@dataclass(frozen=True)
class Config:
    home: str
    embedding: Embedding = field(default_factory=Embedding)
    index_dir: str = ""
    top_k: int = DEFAULT_TOP_K

    @classmethod
    def default(cls, home: str) -> Config:
        return cls(home, index_dir=str(Path(home) / "index"))

    def to_map(self) -> dict[str, dict[str, Any]]:
        e = self.embedding
        optional = {"embeddingDimension": e.dimension, "modelPath": e.model_path and self.relative(e.model_path), "apiKey": e.api_key}
        embedding = {"model": e.model, "modelName": e.model_name} | {k: v for k, v in optional.items() if v is not None} | {"batchSize": e.batch_size}
        return {"embedding": embedding, "index": {"directory": self.relative(self.index_dir)}, "search": {"topK": self.top_k}}

    def relative(self, path: str) -> str:
        path = os.path.normpath(path)
        return os.path.relpath(path, self.home) if Path(path).is_relative_to(self.home) else path


def read_yaml(text: str) -> dict[str, Any]:
    """Two levels of `key: value`, comments, and quoted or plain scalars; ValueError for anything else."""
    root: dict[str, Any] = {}
    section: dict[str, Any] | None = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        key, colon, value = line.strip().partition(":")
        if not colon:
            raise ValueError(f"not a mapping: {line!r}")
        value = scalar(value.strip())
        if line[0] in " \t":
            if section is None:
                raise ValueError(f"indented without a section: {line!r}")
            section[scalar(key)] = value
        elif value is None:
            section = root.setdefault(scalar(key), {})
        else:
            root[scalar(key)], section = value, None
    return root


def scalar(text: str) -> Any:
    if text[:1] in ("'", '"') and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    text = text.split(" #")[0].strip()
    if text in ("", "~", "null", "{}"):
        return None
    return int(text) if text.lstrip("-").isdigit() else text


def write_yaml(sections: dict[str, dict[str, Any]]) -> str:
    plain = lambda v: v if isinstance(v, int) or (v and v.strip() == v and not set(v) & set("#'\"{}[]") and not v.lstrip("-").isdigit()) else "'" + str(v) + "'"
    return "".join(f"{name}:\n" + "".join(f"  {k}: {plain(v)}\n" for k, v in section.items()) for name, section in sections.items())


def resolve(home: str, value: str | None) -> str | None:
    """An absolute normal path; `~` expands, relative ones start at home."""
    if value is None:
        return None
    expanded = os.path.expanduser(value) if value.startswith("~") else value
    return os.path.normpath(expanded if os.path.isabs(expanded) else os.path.join(home, expanded))


def load(home: str | None = None, path: str | None = None) -> Config:
    """The configuration of a home folder; a missing file is written with the defaults, an unreadable one is passed over."""
    home = os.path.abspath(os.path.expanduser(home or DEFAULT_HOME))
    default, file = Config.default(home), Path(path or os.path.join(home, FILE_NAME))
    if not file.exists():
        try:
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(write_yaml(default.to_map()), encoding="utf-8")
        except OSError:
            pass
        return default
    try:
        root = read_yaml(file.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default
    part = lambda name: root.get(name) if isinstance(root.get(name), dict) else {}
    e, base = part("embedding"), default.embedding
    embedding = Embedding(
        blank_to_none(e.get("model")) or base.model,
        blank_to_none(e.get("modelName")) or base.model_name,
        to_int(e.get("embeddingDimension")),
        resolve(home, blank_to_none(e.get("modelPath"))),
        blank_to_none(e.get("apiKey")),
        max(1, to_int(e.get("batchSize")) or base.batch_size) if to_int(e.get("batchSize")) != 0 else 1,
    )
    top_k = to_int(part("search").get("topK"))
    return Config(home, embedding, resolve(home, blank_to_none(part("index").get("directory"))) or default.index_dir, DEFAULT_TOP_K if top_k is None else max(1, top_k))


def with_options(config: Config, **options: Any) -> Embedding:
    """The embedding settings with what a caller passed (model, model_name, dimension, model_path, api_key, batch_size) put over them."""
    e = config.embedding
    model = blank_to_none(options.get("model")) or e.model
    batch, path = options.get("batch_size"), options.get("model_path")
    return Embedding(
        model,
        blank_to_none(options.get("model_name")) or e.model_name or model,
        options["dimension"] if options.get("dimension") is not None else e.dimension,
        os.path.abspath(path) if path is not None else e.model_path,
        blank_to_none(options.get("api_key")) or e.api_key,
        batch if batch is not None and batch > 0 else e.batch_size,
    )
