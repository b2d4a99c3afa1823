"""What a deployment chooses, read from the environment once on the driver."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    data_dir: str
    recognition: str = "local"  # local or cloud
    ocr: str = "auto"  # auto, or a provider's name
    pipeline: str = "v2"  # v1: page kernels alone; v2: with reconciliation and formulas
    formulas: bool = True
    unverified_passes: bool = False

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ, prefix: str = "FOLIOFLOW_") -> Settings:
        get = lambda name, default: env.get(prefix + name, default).strip()
        on = lambda name, default: get(name, default).lower() in ("1", "true", "yes", "on")
        out = cls(get("DATA_DIR", "data"), get("RECOGNITION", "local"), get("OCR", "auto"), get("PIPELINE", "v2"), on("FORMULAS", "1"), on("UNVERIFIED_PASSES", "0"))
        if out.recognition not in ("local", "cloud") or out.pipeline not in ("v1", "v2"):
            raise ValueError(f"unknown setting: {out}")
        return out
