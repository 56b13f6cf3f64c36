"""Language models by description: what is written down names a model, what is run is made from it where it is needed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from driftloom.operators.cache import Memory
from driftloom.operators.features import TextOracle, keyword_oracle

Make = Callable[["ModelSpec"], TextOracle]


@dataclass(frozen=True)
class ModelSpec:
    """A provider's model and its parameters. It alone is stored, never a connection or a key."""

    provider: str
    model: str
    params: tuple[tuple[str, str], ...] = ()

    def to_dict(self) -> dict:
        return {"type": "model", "provider": self.provider, "model": self.model, "params": dict(self.params)}

    @staticmethod
    def from_dict(d: dict) -> "ModelSpec":
        return ModelSpec(d["provider"], d["model"], tuple(sorted(d.get("params", {}).items())))


@dataclass
class Models:
    """Providers by name, and the models made so far; equal descriptions give the same model."""

    providers: dict[str, Make] = field(default_factory=dict)
    most: int = 100

    def __post_init__(self) -> None:
        self._made = Memory(self.most)

    def register(self, provider: str, make: Make) -> None:
        if provider in self.providers:
            raise ValueError(f"provider {provider} is there already")
        self.providers[provider] = make

    def get(self, spec: ModelSpec) -> TextOracle:
        if spec.provider not in self.providers:
            raise KeyError(f"no provider {spec.provider}: {sorted(self.providers)}")
        return self._made.get(spec, lambda: self.providers[spec.provider](spec))

    def clear(self) -> None:
        self._made.clear()


def default_models() -> Models:
    """With the deterministic stand-in only; there is no network here."""
    m = Models()
    m.register("keyword", lambda spec: keyword_oracle())
    return m
