"""Parameters of the operators, with their defaults."""

from dataclasses import dataclass


@dataclass(frozen=True)
class InferenceConfig:
    """direction: "past" compares an event with earlier ones, "both" with later ones, too. target_mode: "literal" takes
    the trigger word itself as the related entity, "nearest_other" the closest token outside the match and not the event's own id."""

    min_confidence: float = 0.7
    window_s: int = 3600
    min_similarity: float = 0.3
    frequency_similarity: float = 0.5
    min_co_occurrence: int = 3
    expires_after_ms: int = 3_600_000
    max_explicit: int = 5
    direction: str = "past"
    target_mode: str = "literal"


@dataclass(frozen=True)
class CompactionConfig:
    max_bytes: int = 1 << 20
    max_relationships: int = 10_000
    idle_ms: int = 86_400_000
    min_frequency: float = 0.1
    default_frequency: float = 0.5
    min_priority: float = 0.5
    batch: int = 100


@dataclass(frozen=True)
class PressureLimits:
    max_queue: int = 10_000
    max_backlog: int = 100
    max_memory: float = 0.8
