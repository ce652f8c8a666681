"""Settings of a deployment, with overrides from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Model names, limits and thresholds. Operators take the values as arguments; these are their defaults in one place."""

    orchestrator_model: str = "qwen3:14b"
    vision_primary: str = "qwen3-vl:8b"
    vision_fallback: str = "qwen3-vl:4b"
    deep_review_model: str | None = None  # null: the orchestrator's
    math_ocr_engine: str = "pix2tex"
    mathpix_app_id: str = ""
    mathpix_app_key: str = ""
    max_rounds: int = 4
    quality_threshold: float = 8.0
    low_confidence_threshold: float = 5.0
    judge_skip_threshold: float = 9.0
    scanned_text_threshold: int = 100
    image_area_threshold: float = 0.4
    math_formula_threshold: int = 3
    context_token_limit: int = 8_000
    content_loss_limit: float = 0.35
    format_num_ctx: int = 32_768
    vision_timeout: float = 1800
    format_timeout: float = 900
    stall_seconds: float = 150

    @property
    def reviewer(self) -> str:
        return self.deep_review_model or self.orchestrator_model

    @property
    def format_chars(self) -> int:
        """Characters that a formatting model is given: about three a token."""
        return 3 * self.format_num_ctx


def override(base: Settings, given: dict[str, object]) -> Settings:
    """base with the given values; names in capitals or not, unknown ones and values of another kind left out."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    take = {}
    for name, value in given.items():
        kind = kinds.get(str(name).lower())
        if kind is None:
            continue
        if kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if kind is type(None) and isinstance(value, str) or type(value) is kind:
            take[str(name).lower()] = value
    return replace(base, **take)


def load(path: str | Path) -> Settings:
    """The defaults with the overrides of a JSON file; the defaults where there is none or it can't be read."""
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return Settings()
    return override(Settings(), given) if isinstance(given, dict) else Settings()
