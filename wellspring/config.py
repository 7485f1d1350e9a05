"""One flat, immutable settings object shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    # calendar
    seasons: dict = field(
        default_factory=lambda: {
            "pre_monsoon": (3, 4, 5),
            "monsoon": (6, 7, 8, 9),
            "post_monsoon": (10, 11),
            "rabi": (12, 1, 2),
        }
    )
    monsoon_start_month: int = 6
    train_end: str = "2020-11-30"
    val_end: str = "2022-06-30"
    test_end: str = "2023-08-31"
    last5_start: str = "2018-08-01"
    daily_start: str = "2013-01-01"
    history_floor: str = "2012-09-03"
    gw_end: str = "2023-08-15"
    end_date: str = "2026-08-07"
    scenario_date: str = "2026-06-30"

    # geography
    lat_min: float = 15.6
    lat_max: float = 22.1
    lon_min: float = 72.6
    lon_max: float = 80.9
    cell_degrees: float = 0.25

    # features
    horizon_days: int = 30
    lags: tuple = (7, 15, 30, 60, 90)
    rolling_days: tuple = (7, 30, 90)
    rain_day_mm: float = 2.5
    fetch_lead_days: int = 120
    fetch_tail_days: int = 30

    # registry quality control
    min_readings: int = 40
    min_year_coverage: float = 0.60
    max_repeat_run: int = 4
    max_plausible_m: float = 100.0

    # reconstruction
    confidence_tau_days: float = 45.0
    min_readings_to_rebuild: int = 4
    min_level_m: float = 0.05

    # scoring
    monitor_above: float = 40.0
    act_now_above: float = 70.0
    crisis_share: float = 0.90
    trend_lookback_days: int = 30
    trend_min_window_days: int = 7

    # evaluation
    truth_cutoff: float = 71.0
    target_recall: float = 0.80
    ring_halfwidth_days: int = 15

    # report validation
    report_sd_m: float = 1.0
    z_accept: float = 2.0
    z_flag: float = 3.5
    report_max_m: float = 200.0
    prior_sd_floor_m: float = 0.25

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @property
    def month_to_season(self) -> dict:
        return {m: name for name, months in self.seasons.items() for m in months}


DEFAULTS = Settings()
