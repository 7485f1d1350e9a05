"""The 0-100 stress score, term by term."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions.calendar import lookup
from wellspring.functions.numeric import clip

# Band names, colours, labels per language, provenance ranks.
BANDS = ("SAFE", "MONITOR", "ACT NOW")
BAND_COLOURS = {"SAFE": "GREEN", "MONITOR": "AMBER", "ACT NOW": "RED"}
BAND_LABELS = {
    "SAFE": {"en": "Safe", "mr": "सुरक्षित", "hi": "सुरक्षित"},
    "MONITOR": {"en": "Monitor", "mr": "लक्ष ठेवा", "hi": "निगरानी रखें"},
    "ACT NOW": {"en": "Act now", "mr": "त्वरित कृती", "hi": "तुरंत कार्रवाई"},
}
SOURCE_RANK = {"wrd_pravah": 0, "manual": 1, "interpolated": 2}
UNKNOWN_SOURCE_RANK = 9


def depletion(pct: Column) -> Column:
    """0-60: how empty, steeper as storage runs out (breaks at 80, 30, 10)."""
    floor0 = F.greatest(pct, F.lit(0.0))
    return (
        F.when(pct >= 80, 0.0)
        .when(pct >= 30, (F.lit(80.0) - pct) / F.lit(50.0) * F.lit(30.0))
        .when(pct >= 10, F.lit(30.0) + (F.lit(30.0) - pct) / F.lit(20.0) * F.lit(18.0))
        .when(
            pct < 10,
            F.least(F.lit(60.0), F.lit(48.0) + (F.lit(10.0) - floor0) / F.lit(10.0) * F.lit(12.0)),
        )
    )


def decline(pp_per_day: Column) -> Column:
    """0-25: only a fall is penalised; full at 0.30 points per day."""
    falling = F.least(F.lit(25.0), F.abs(pp_per_day) / F.lit(0.30) * F.lit(25.0))
    return F.when(pp_per_day < 0, falling).otherwise(F.lit(0.0))


def runway(days: Column) -> Column:
    """0-15: nothing at 90 days of supply or more, full at 15 or less."""
    return (
        F.when(days.isNull() | (days >= 90), F.lit(0.0))
        .when(days <= 15, F.lit(15.0))
        .otherwise((F.lit(90.0) - days) / F.lit(75.0) * F.lit(15.0))
    )


def band(score: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(
        score.isNotNull(),
        F.when(score > settings.act_now_above, "ACT NOW")
        .when(score > settings.monitor_above, "MONITOR")
        .otherwise("SAFE"),
    )


def band_rank(name: Column) -> Column:
    return lookup({b: i for i, b in enumerate(BANDS)}, name)


def colour(name: Column) -> Column:
    return lookup(BAND_COLOURS, name)


def band_label(name: Column, lang: Column) -> Column:
    """Band in the asked language; English when the language is unknown."""
    flat = {f"{b}|{lg}": text for b, row in BAND_LABELS.items() for lg, text in row.items()}
    return F.coalesce(
        lookup(flat, F.concat_ws("|", name, lang)),
        lookup(flat, F.concat_ws("|", name, F.lit("en"))),
        name,
    )


def depth_score(level: Column, shallow: Column, crisis: Column) -> Column:
    span = F.greatest(crisis - shallow, F.lit(0.5))
    return clip((level - shallow) / span * F.lit(60.0), 0.0, 60.0)


def deepening_score(m_per_day: Column) -> Column:
    rising = F.least(F.lit(25.0), m_per_day / F.lit(0.05) * F.lit(25.0))
    return F.when(m_per_day > 0, rising).otherwise(F.lit(0.0))


def headroom_score(level: Column, well_depth: Column) -> Column:
    share = level / F.when(well_depth > 0, well_depth)
    return F.coalesce(
        clip((share - F.lit(0.6)) / F.lit(0.4) * F.lit(15.0), 0.0, 15.0), F.lit(0.0)
    )


def level_score(
    level: Column, shallow: Column, crisis: Column, m_per_day: Column, well_depth: Column
) -> Column:
    """Unrounded score used when forecasts are evaluated; NULL trend counts as 0."""
    return (
        depth_score(level, shallow, crisis)
        + deepening_score(F.coalesce(m_per_day, F.lit(0.0)))
        + headroom_score(level, well_depth)
    )


def days_to_crisis(crisis: Column, last_level: Column, m_per_day: Column) -> Column:
    room = crisis - last_level
    return F.when((m_per_day > 0) & (room > 0), F.floor(room / m_per_day).cast("long"))


def source_rank(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_RANK, source), F.lit(UNKNOWN_SOURCE_RANK))


def worst_source(own: Column, other: Column) -> Column:
    """The less trustworthy of two provenances; the first wins a tie."""
    return F.when(other.isNull() | (source_rank(own) >= source_rank(other)), own).otherwise(other)
