"""Errors, raised while a plan is built wherever possible rather than in tasks."""

from __future__ import annotations


class EmbervaneError(Exception):
    """Base of all errors of this package."""


class InvalidInput(EmbervaneError, ValueError):
    """An argument or a table that an operation can't take."""


class ConfigError(EmbervaneError):
    """A model or index setting that is missing or wrong."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field, self.message = field, message


class TokenizationError(EmbervaneError):
    """A failure in one stage of tokenisation."""

    def __init__(self, stage: str, detail: str):
        super().__init__(f"{stage}: {detail}")
        self.stage, self.detail = stage, detail


class TensorError(EmbervaneError):
    """Shapes or buffers that don't fit together."""


class TokenizerError(EmbervaneError):
    """A vocabulary that can't be used."""


class ModelError(EmbervaneError):
    """Weights that are missing, damaged or of the wrong shape."""


class SourceError(EmbervaneError, OSError):
    """A file or folder that can't be read or written."""


class JsonError(EmbervaneError):
    """Malformed JSON."""


class StoreError(EmbervaneError):
    """A chunk store that is missing or damaged."""
