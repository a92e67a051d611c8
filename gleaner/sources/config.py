"""Ingestion settings: YAML files, checked and completed with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path

from .files import FILE_TYPES

#: Ways to cut text into chunks, and endings of settings files.
STRATEGIES, ENDINGS = ("fixed", "markdown", "semantic"), (".yaml", ".yml")


@dataclass(frozen=True)
class IngestConfig:
    directory: str
    image_dimensions: int
    collection_name: str = "default_collection"
    file_types: tuple[str, ...] = field(default=FILE_TYPES)
    chunk_size: int = 500
    chunk_overlap: int = 50
    chunk_strategy: str = "fixed"
    semantic_threshold: float = 0.5
    dimensions: int | None = None

    def __post_init__(self):
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError(f"chunk_overlap ({self.chunk_overlap}) must be less than chunk_size ({self.chunk_size})")
        object.__setattr__(self, "file_types", tuple(t.lower() for t in self.file_types))


def of_mapping(values: dict) -> IngestConfig:
    """Settings from a mapping; unknown keys are refused, as is a missing required one."""
    known = {f.name for f in fields(IngestConfig)}
    if odd := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    try:
        return IngestConfig(**values)
    except TypeError as problem:
        raise ValueError(str(problem)) from problem


def load(path: str) -> IngestConfig:
    """Settings from a YAML file, where a YAML reader is installed."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return of_mapping(yaml.safe_load(f) or {})


def listed(root: str) -> list[str]:
    """Settings files directly below a folder, sorted."""
    return sorted(p.name for p in Path(root).iterdir() if p.suffix in ENDINGS) if Path(root).is_dir() else []


def contained(path: str, root: str) -> Path:
    """The resolved path of a settings file, which must exist below ``root``."""
    found = (Path(root) / path).resolve()
    if not found.is_relative_to(Path(root).resolve()):
        raise ValueError("the path must be below the settings folder")
    if not found.exists():
        raise ValueError(f"no such file: {path}")
    if found.suffix.lower() not in ENDINGS:
        raise ValueError("settings must be a YAML file (.yaml or .yml)")
    return found


def template(source: str, base_dir: str | None = None) -> str:
    """A template by path, by path below ``base_dir``, or else the text itself."""
    for path in (Path(source), *([Path(base_dir) / source] if base_dir else [])):
        try:
            if path.is_file():
                return path.read_text(encoding="utf-8")
        except OSError:  # a text too long for a path
            continue
    return source


def dimensions_of(embed, spark) -> int:
    """Length of an embedder's vectors, found by embedding one word."""
    from pyspark.sql import functions as F

    return spark.range(1).select(F.size(embed(F.lit("probe"))).alias("n")).first()["n"]
