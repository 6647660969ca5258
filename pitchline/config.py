"""Settings with defaults; each can be overridden by an environment variable PITCHLINE_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    random_seed: int = 42
    rolling_window_n: int = 5
    elo_base: float = 1500.0
    elo_k: float = 20.0
    elo_home_advantage: float = 65.0
    cv_splits: int = 5
    dc_max_goals: int = 10
    dc_half_life_days: int | None = None
    seasons_back: int = 10
    season_matchdays: int = 38
    data_dir: str = "data"

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """Defaults, with PITCHLINE_ELO_K and the like on top; an empty value means None."""
        env = dict(os.environ) if env is None else env
        kinds = {"int": int, "float": float, "str": str, "int | None": lambda v: int(v) if v else None}
        own = {f.name: kinds[f.type](env[key]) for f in fields(Settings) if (key := f"PITCHLINE_{f.name.upper()}") in env}
        return Settings(**own)


SETTINGS = Settings.from_env()
