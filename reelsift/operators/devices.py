"""What accelerators the driver's machine has."""

from __future__ import annotations

import importlib.util
from functools import lru_cache

from reelsift.errors import GPUDependencyError


@lru_cache(maxsize=1)
def _missing() -> tuple[str, ...]:
    missing = [m for m in ("torch", "torchvision") if importlib.util.find_spec(m) is None]
    if not missing:
        import torch

        if not torch.cuda.is_available():
            missing.append("a CUDA device")
    return tuple(missing)


class DeviceCapabilities:
    """Cached detection of a usable GPU."""

    @staticmethod
    def is_available() -> bool:
        return not _missing()

    @staticmethod
    def get_missing_dependencies() -> list[str]:
        return list(_missing())

    @staticmethod
    def get_info() -> dict:
        return {"available": not _missing(), "missing": list(_missing())}

    @staticmethod
    def reset_cache() -> None:
        _missing.cache_clear()


def choose_device(device: str = "auto") -> str:
    """``cuda`` or ``cpu``; asking for ``cuda`` without one is a ``GPUDependencyError``."""
    if device == "auto":
        return "cuda" if DeviceCapabilities.is_available() else "cpu"
    if device == "cuda" and not DeviceCapabilities.is_available():
        raise GPUDependencyError(f"missing: {', '.join(DeviceCapabilities.get_missing_dependencies())}")
    return device
