"""Bounded and rounded scores, bands and tenure arithmetic.  Rounding is half up; clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and thresholds of matching and of the scorecard.
PRIORITY_WEIGHTS = {"required": 2, "preferred": 1}
STATUS_VALUES = {"matched": 1.0, "partially_matched": 0.5}
LEXICAL_WEIGHT, VECTOR_WEIGHT = 0.7, 0.3
MATCHED_LEXICAL, PARTIAL_LEXICAL, ADMITTED_VECTOR = 0.65, 0.25, 0.45
QUALITY_BANDS = ((85, "excellent"), (70, "strong"), (50, "moderate"), (30, "weak"))
SCORECARD_WEIGHTS = {"keyword": 20, "skill": 25, "technology": 25, "experience": 15, "project": 10, "education": 5}
DAYS_MERGED, DAYS_SUMMED = "365.2425", 365.25


def unit_score(value: Column) -> Column:
    """A score clamped to 0..1 with four decimals."""
    return F.round(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).cast("decimal(20,15)"), 4).cast("decimal(5,4)").cast("double")


def percent(part: Column, whole: Column, empty: float) -> Column:
    """100 * part / whole with two decimals; ``empty`` where the whole is 0."""
    ratio = F.round(F.try_divide(part.cast("decimal(20,4)") * 100, whole.cast("decimal(20,4)")).cast("decimal(28,12)"), 2).cast("double")
    return F.coalesce(ratio, F.lit(empty))


def bounded(value: Column) -> Column:
    return F.round(F.least(F.greatest(value, F.lit(0)), F.lit(100)).cast("decimal(28,12)"), 2).cast("double")


def band(score: Column) -> Column:
    out = F.lit("limited")
    for least, name in reversed(QUALITY_BANDS):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def hybrid(lexical: Column, vector: Column) -> Column:
    return F.least(F.lit(1.0), lexical * LEXICAL_WEIGHT + vector * VECTOR_WEIGHT)


def years(days: Column) -> Column:
    """Years of merged intervals, two decimals."""
    return F.round((days.cast("decimal(20,4)") / F.lit(DAYS_MERGED).cast("decimal(10,4)")).cast("decimal(28,12)"), 2).cast("double")


def status_of(best_lexical: Column, has_citation: Column, exact: Column) -> Column:
    """The status gate over admitted citations; all scores are the rounded ones."""
    matched = has_citation & (exact | (best_lexical >= MATCHED_LEXICAL))
    return F.when(matched, "matched").when(has_citation & (best_lexical >= PARTIAL_LEXICAL), "partially_matched").otherwise("not_evidenced")
