"""Settings of a generation run, from the environment (`SCENEKILN_*`) or a `.env` file; unknown keys are passed over."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "SCENEKILN_"


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values. Only `seed` drives a run; the rest is shown and checked."""

    seed: int = 42
    min_focus: float = 120.0
    max_aspect_ratio: float = 1.6
    cards_per_scene_min: int = 2
    cards_per_scene_max: int = 3

    def __post_init__(self) -> None:
        if self.min_focus < 0 or self.max_aspect_ratio <= 1:
            raise ValueError("min_focus is 0 at least and max_aspect_ratio over 1")
        if not all(2 <= n <= 3 for n in (self.cards_per_scene_min, self.cards_per_scene_max)):
            raise ValueError("a scene has two or three cards")

    @classmethod
    def load(cls, env_file: str = ".env") -> Settings:
        found: dict[str, str] = {}
        if Path(env_file).is_file():
            lines = (line.split("#", 1)[0].strip() for line in Path(env_file).read_text().splitlines())
            found |= {k.strip(): v.strip().strip("\"'") for k, _, v in (line.partition("=") for line in lines if "=" in line)}
        found |= os.environ
        own = {k.upper(): v for k, v in found.items()}
        kinds = {"int": int, "float": float}
        return cls(**{f.name: kinds[f.type](own[key]) for f in fields(cls) if (key := (PREFIX + f.name).upper()) in own})
