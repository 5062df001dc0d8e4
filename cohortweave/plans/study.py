"""The whole study: from days of supply and sources to the baseline table and the modelling frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortweave.functions.rows import binary
from cohortweave.operators.episodes import index_episodes, treatment_episodes, user_type
from cohortweave.plans.cohort import ARM, PERSON, START, Sources, Study, baseline, exposure_with_death, followup
from cohortweave.session import staged
from cohortweave.stats.features import baseline_features, median_impute


@dataclass(frozen=True)
class StudyFrames:
    """Stage tables of a study: all episodes, index rows (user type, heart-failure and death date), baseline rows."""

    episodes: DataFrame
    index: DataFrame
    baseline: DataFrame


def study(days: DataFrame, eligible: DataFrame, prior: DataFrame, deaths: DataFrame, src: Sources, params: Study,
          required: str = "hf_date") -> StudyFrames:
    """Episodes, index rows and baseline rows, each kept once it is made, since the next steps read it several times.

    ``days`` are days of supply per (person, arm, start), ``eligible`` has the persons' eligibility and heart-failure dates, ``prior`` the
    comparator fills, ``deaths`` the death dates.  Index rows without the ``required`` date are left out.
    """
    episodes = staged(treatment_episodes(days, [PERSON, ARM]))
    first = staged(index_episodes(episodes, [PERSON, ARM]))
    dated = first.join(eligible.select(PERSON, "eligible_date", "hf_date"), PERSON)
    index = staged(exposure_with_death(dated, user_type(first, prior), deaths, params.cutoff, required))
    return StudyFrames(episodes, index, staged(baseline(index, src, params)))


def modelling_frame(table: DataFrame, params: Study, exposed: str, features: Mapping[str, Column] | None = None,
                    impute: Sequence[str] = ()) -> DataFrame:
    """Baseline rows with exposure, follow-up to death or the cut-off, derived features and medians for missing numbers.

    Rows whose follow-up ends before it starts are left out.
    """
    rows = followup(table, START, "death_date", params.cutoff).where("periods >= 1")
    rows = rows.withColumns({"exp": binary(ARM, exposed), "row_key": F.concat_ws("|", F.col(PERSON).cast("string"), ARM)})
    rows = baseline_features(rows, features or {})
    return median_impute(staged(rows), list(impute)) if impute else rows
