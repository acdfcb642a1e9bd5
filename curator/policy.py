"""Scoring rules as data: defaults, and other versions read from small tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curator import constants as K

#: Rows that one version of a rule table may have; it is read on the driver.
MOST_ROWS = 10_000


def _rows(table: DataFrame, version: str) -> list:
    """The rows (section, name, item, value) of one version."""
    rows = table.where(F.col("version") == version).select("section", "name", "item", "value").limit(MOST_ROWS + 1).collect()
    if not rows:
        raise ValueError(f"no policy has version {version!r}")
    if len(rows) > MOST_ROWS:
        raise ValueError(f"policy {version!r} has more than {MOST_ROWS} rows")
    return rows


def _nested(rows: list, section: str) -> dict[str, dict[str, int]]:
    out: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["section"] == section:
            out.setdefault(r["name"], {})[r["item"]] = int(r["value"])
    return out


def _flat(rows: list, section: str) -> dict[str, str]:
    return {r["name"]: r["value"] for r in rows if r["section"] == section}


@dataclass(frozen=True)
class ScoreConfig:
    """Weights, penalties and terms of the additive story score."""

    weights: dict[str, int] = field(default_factory=lambda: dict(K.SCORE_WEIGHTS))
    penalties: dict[str, int] = field(default_factory=lambda: dict(K.SCORE_PENALTIES))
    workflow_terms: tuple[str, ...] = K.WORKFLOW_TERMS
    weak_terms: tuple[str, ...] = K.WEAK_EVIDENCE_TERMS
    noise_terms: tuple[str, ...] = K.NOISE_TERMS

    @staticmethod
    def from_table(table: DataFrame, version: str) -> ScoreConfig:
        """table: version, section ('weight', 'penalty', 'workflow_term', 'weak_term', 'noise_term'), name, item, value.

        What a version doesn't state keeps its default; a list of terms is replaced as a whole.
        """
        rows, base = _rows(table, version), ScoreConfig()
        terms = lambda s, old: tuple(sorted(_flat(rows, s))) or old
        numbers = lambda s: {k: int(v) for k, v in _flat(rows, s).items()}
        unknown = (set(numbers("weight")) - set(base.weights)) | (set(numbers("penalty")) - set(base.penalties))
        if unknown:
            raise ValueError(f"unknown score parts: {', '.join(sorted(unknown))}")
        return replace(
            base, weights={**base.weights, **numbers("weight")}, penalties={**base.penalties, **numbers("penalty")},
            workflow_terms=terms("workflow_term", base.workflow_terms), weak_terms=terms("weak_term", base.weak_terms),
            noise_terms=terms("noise_term", base.noise_terms))


@dataclass(frozen=True)
class SelectionPolicy:
    """Profiles, caps and thresholds of the weighted score, the decision and the escalation."""

    profiles: dict[str, dict[str, int]] = field(default_factory=lambda: {k: dict(v) for k, v in K.PROFILES.items()})
    flag_caps: dict[str, dict[str, int]] = field(default_factory=lambda: {k: dict(v) for k, v in K.FLAG_CAPS.items()})
    defer_flags: tuple[str, ...] = K.DEFER_FLAGS
    select_at: int = K.SELECT_AT
    reject_below: int = K.REJECT_BELOW
    confidence_floor: float = K.CONFIDENCE_FLOOR
    threshold_margin: int = K.THRESHOLD_MARGIN

    @staticmethod
    def from_table(table: DataFrame, version: str) -> SelectionPolicy:
        """table: version, section ('profile': profile, dimension, weight; 'cap': flag, dimension, most; 'defer': flag;
        'threshold': its name, '', number), name, item, value. Stated sections replace the default ones."""
        rows, base = _rows(table, version), SelectionPolicy()
        thresholds = _flat(rows, "threshold")
        numbers = ("select_at", "reject_below", "confidence_floor", "threshold_margin")
        unknown = {d for w in _nested(rows, "profile").values() for d in w} - set(K.DIMENSIONS) | (set(thresholds) - set(numbers))
        if unknown:
            raise ValueError(f"unknown dimensions or thresholds: {', '.join(sorted(unknown))}")
        return replace(
            base, profiles={p: {d: w.get(d, 0) for d in K.DIMENSIONS} for p, w in _nested(rows, "profile").items()} or base.profiles,
            flag_caps=_nested(rows, "cap") or base.flag_caps, defer_flags=tuple(_flat(rows, "defer")) or base.defer_flags,
            **{n: type(getattr(base, n))(float(thresholds[n])) for n in numbers if n in thresholds})
