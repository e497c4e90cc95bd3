"""Configuration: retrieval settings, presets, providers and profiles."""

from __future__ import annotations

import dataclasses
import json
import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Retrieval:
    """Retrieval settings.  Only ``dense_k`` changes results; the rest is reported or reserved."""

    hybrid: bool = False
    dense_k: int = 5
    sparse_k: int = 10
    rerank_pool: int = 10
    top_n: int = 5
    compression: bool = False
    target_tokens: int = 1600
    raptor: str = "off"
    graph: bool = False
    coverage_target: float = 0.7
    max_context_tokens: int = 4096

    def __post_init__(self):
        if self.dense_k < 0:
            raise ValueError("dense_k must not be negative")


# The presets, and above the names and defaults of the settings.
PRESETS = {
    "fast": Retrieval(dense_k=3, sparse_k=5, top_n=3, target_tokens=800, coverage_target=0.5, max_context_tokens=2048),
    "balanced": Retrieval(),
    "thorough": Retrieval(dense_k=10, sparse_k=20, top_n=8, target_tokens=3000, coverage_target=0.9, max_context_tokens=8192),
}


@dataclass(frozen=True)
class Provider:
    name: str
    base_url: str
    planner_model: str | None = None
    gatherer_model: str | None = None
    generator_model: str | None = None
    api_key: str | None = None

    def __post_init__(self):
        if not self.base_url.startswith(("http://", "https://")):
            raise ValueError("base_url must be an http address")


@dataclass(frozen=True)
class Profile:
    name: str
    provider: Provider


@dataclass(frozen=True)
class Config:
    profile: str = "Default"
    provider: Provider | None = None
    provider_profiles: tuple[Profile, ...] = ()
    retrieval: Retrieval = Retrieval()

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Config:
        raw = json.loads(text)
        return cls(
            profile=raw.get("profile", "Default"),
            provider=Provider(**raw["provider"]) if raw.get("provider") else None,
            provider_profiles=tuple(Profile(p["name"], Provider(**p["provider"])) for p in raw.get("provider_profiles", [])),
            retrieval=Retrieval(**raw.get("retrieval", {})),
        )

    def with_profile(self, name: str) -> Config:
        """The first profile of that name becomes the provider; without any profiles nothing changes."""
        if not self.provider_profiles:
            return self
        found = next((p for p in self.provider_profiles if p.name == name), None)
        if found is None:
            raise KeyError(f"no profile {name!r}")
        return dataclasses.replace(self, provider=found.provider, profile=name)

    def with_preset(self, name: str) -> Config:
        """The preset of that name, in any case."""
        if name.lower() not in PRESETS:
            raise KeyError(f"no preset {name!r}")
        return dataclasses.replace(self, retrieval=PRESETS[name.lower()])

    def with_saved_profile(self, name: str) -> Config:
        """The current provider as a further profile."""
        if self.provider is None:
            raise ValueError("no provider to save")
        return dataclasses.replace(self, provider_profiles=(*self.provider_profiles, Profile(name, self.provider)))


class ConfigStore:
    """One JSON file on the driver; the first read writes the defaults."""

    def __init__(self, path: str):
        self.path = path

    def read(self) -> Config:
        if not os.path.exists(self.path):
            self.write(Config())
        with open(self.path, encoding="utf-8") as file:
            return Config.from_json(file.read())

    def write(self, config: Config) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(f"{self.path}.new", "w", encoding="utf-8") as file:
            file.write(config.to_json())
        os.replace(f"{self.path}.new", self.path)
