"""Options of the embedding operator."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

from .errors import InvalidInput

Pooling = Literal["mean", "cls"]


@dataclass(frozen=True)
class EmbedOptions:
    max_length: int = 128
    pooling: Pooling = "mean"
    normalize: bool = True

    def __post_init__(self) -> None:
        if self.pooling not in ("mean", "cls"):
            raise InvalidInput(f"unknown pooling {self.pooling!r}")

    def with_max_length(self, n: int) -> EmbedOptions:
        return replace(self, max_length=n)

    def with_pooling(self, pooling: Pooling) -> EmbedOptions:
        return replace(self, pooling=pooling)

    def with_normalize(self, on: bool) -> EmbedOptions:
        return replace(self, normalize=on)

    def checked(self, max_positions: int) -> EmbedOptions:
        """Itself, if a model with so many positions can take it."""
        if not 2 <= self.max_length <= max_positions:
            raise InvalidInput(f"max_length {self.max_length} is not in 2..{max_positions}")
        return self
