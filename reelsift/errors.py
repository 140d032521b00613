"""Exceptions of the engine."""

from __future__ import annotations


class SelectionError(Exception):
    """Base of everything this package raises on purpose."""


class ConfigurationError(SelectionError):
    """A pipeline that can't run: wrong stage types, or tags that no earlier tagger gives."""


class GPUDependencyError(SelectionError):
    """An accelerator was asked for that isn't there."""
