"""Thresholds of the analysis, with the study's presets as defaults. Thresholds and state names are fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    time_zone: str = "America/Chicago"
    grain_s: int = 3600
    share_tolerance: float = 0.02
    min_hours: int = 4
    min_coverage: float = 0.95
    min_valid_ratio: float = 0.60
    exposure_floor: float = 1e-6
    min_events_per_state: float = 5.0
    control_days: tuple[int, ...] = (-1, -2)
    match_limit: int = 3
    missingness_cuts: tuple[int, ...] = (0, 10, 20, 30)
    min_hours_sweep: tuple[int, ...] = (4, 12, 24, 48)
    allowed_cohorts: tuple[str, ...] = ("control", "intervention", "observational")


DEFAULT = Thresholds()
UNIT = ["site_id", "division_id", "monitor_id", "subject_id"]
STATES = ("chair", "bed", "room", "no_patient")
