"""Tunable values shared by operators and jobs."""

from __future__ import annotations

from dataclasses import dataclass, field

# Result-defining defaults.
UNDOCUMENTED = "(undocumented)"
FLOOD_WINDOW = "10 minutes"
FLOOD_THRESHOLD = 10
COOCCUR_WINDOW_S = 60.0
COOCCUR_MIN_SUPPORT = 0.8
LOW_SUPPORT_ROWS = 20
DETECTOR_WINDOW = 288
STD_FLOOR = 1e-9
MAX_DOUBLE = 1.7976931348623157e308
LEARNING_RATE = 0.1
NUISANCE_THRESHOLD = 0.9
COLLAPSE_WINDOW_S = 60
RING_SIZE = 2000
MAX_SITE_RATE = 10_000.0
MAX_CODE_SHARE_PCT = 95.0


@dataclass(frozen=True)
class RawLayout:
    """Names used by the raw monthly files."""

    alarm_prefix: str = "tblAlarmLog"
    alarm_time: str = "TimeOn"
    alarm_end: str = "TimeOff"
    alarm_station: str = "StationNr"
    alarm_code: str = "Alarmcode"
    scada_time: str = "TimeStamp"
    scada_station: str = "StationId"
    scada_excluded: tuple[str, ...] = ("wtc_ActRegSt_endvalue",)


@dataclass(frozen=True)
class PolicySettings:
    """Learning settings; a journal must keep one value of each."""

    learning_rate: float = LEARNING_RATE
    nuisance_threshold: float = NUISANCE_THRESHOLD
    collapse_window_s: int = COLLAPSE_WINDOW_S
    ring_size: int = RING_SIZE

    def __post_init__(self) -> None:
        if not self.learning_rate > 0:
            raise ValueError("learning_rate must be positive")
        if not 0.5 < self.nuisance_threshold <= 1:
            raise ValueError("nuisance_threshold must lie in (0.5, 1]")
        if self.collapse_window_s <= 0 or self.ring_size <= 0:
            raise ValueError("collapse_window_s and ring_size must be positive")


@dataclass(frozen=True)
class Settings:
    raw: RawLayout = field(default_factory=RawLayout)
    policy: PolicySettings = field(default_factory=PolicySettings)
