"""Settings as values: one immutable record that operators take their parameters from, and its file of changes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    similarity_threshold: float = 0.45
    section_threshold: float = 0.55
    fusion_alpha: float = 0.6
    fusion_neighbours: int = 10
    fusion_rounds: int = 15
    recommendations: int = 1
    exploration_ratio: float = 0.25
    min_novelty: float = 0.30
    relevance_floor: float = 0.30
    explore_floor: float = 0.25
    damping: float = 0.85
    diversity: float = 0.7
    half_life_days: float = 90.0
    capsule_match: float = 0.92
    causal_minimum: float = 0.20
    scout_size: int = 300
    scout_slate: int = 12
    watch_threshold: float = 0.35
    snowball_rating: float = 7.0
    snowball_seeds: int = 10

    def with_(self, **changes) -> Settings:
        """A copy with some values changed; names that no setting has are refused."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise KeyError(f"no such setting: {', '.join(sorted(unknown))}")
        return replace(self, **changes)

    def dumps(self) -> str:
        """Only what differs from the defaults."""
        standard = asdict(Settings())
        return json.dumps({k: v for k, v in asdict(self).items() if v != standard[k]}, indent=1, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Settings:
        """The defaults with the stored values; stored names that are no longer settings are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(text or "{}").items() if k in known})
