"""Settings of runs: defaults, a JSON file over them, and environment variables over both."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """provider and model name the judge; samples are how many chunks and boundaries are judged; embedding_mode is `model` or `judge`."""

    provider: str = "anthropic"
    model: str = ""
    base_url: str = ""
    key_variable: str = ""
    pause: float = 0.2
    self_sample: int = 10
    boundary_sample: int = 8
    embedding_mode: str = "model"
    top_k: int = 5

    def __post_init__(self):
        if self.provider not in ("anthropic", "gemini", "ollama"):
            raise ValueError(f"unknown provider {self.provider!r}")
        if self.embedding_mode not in ("model", "judge"):
            raise ValueError(f"unknown embedding mode {self.embedding_mode!r}")
        if not 3 <= self.self_sample <= 20:
            raise ValueError(f"self_sample = {self.self_sample} is not within 3 to 20")


def load_settings(spark: SparkSession | None = None, path: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "PASSAGELAB_") -> Settings:
    """The settings of a JSON file at any path that Spark reads, and of variables such as PASSAGELAB_TOP_K over it. Unknown names in the file are errors."""
    environment = os.environ if environment is None else environment
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    found = {}
    if path:
        found = json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        if unknown := set(found) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    found |= {name: environment[prefix + name.upper()] for name in kinds if prefix + name.upper() in environment}
    return replace(Settings(), **{name: kinds[name](value) for name, value in found.items()})
