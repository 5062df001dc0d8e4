"""Identity resolution, star merge and one-row values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def to_person(fact: DataFrame, crosswalk: DataFrame, cohort: DataFrame | None = None,
              site: str = "site_id", person: str = "person_id") -> DataFrame:
    """Replace the site-level id of a fact table by the person id, for cohort persons only.

    The crosswalk is cut to the cohort first, so the fact table meets the smallest
    possible side; the fact side stays the probe side, which AQE can split when one
    site id is hot.  No size is assumed: Spark picks broadcast or shuffle by
    measured size.  The crosswalk has one row per site id.
    """
    links = crosswalk.select(site, person)
    if cohort is not None:
        links = links.join(cohort.select(person), person, "left_semi")
    return fact.join(links, site, "inner").drop(site)


def unique_rows(df: DataFrame, keys: Sequence[str], what: str = "covariate") -> DataFrame:
    """The same rows, failing at run time when a key occurs twice.

    A frame that was built by grouping on ``keys`` needs no further shuffle here.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*rest)).alias("_v"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{what}: key {list(keys)} is not unique"))
                     .cast(grouped.schema["_v"].dataType)).otherwise(F.col("_v"))
    return grouped.select(*keys, checked.alias("_v")).select(*keys, *[F.col("_v")[c].alias(c) for c in rest])


def merge_covariates(base: DataFrame, frames: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-merge covariate frames onto the base; the row count cannot grow."""
    out = base
    for name, frame in frames.items():
        out = out.join(unique_rows(frame, keys, name), list(keys), "left")
    return out


def with_scalar(df: DataFrame, source: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a one-row aggregate of ``source`` to every row of ``df``."""
    return df.crossJoin(F.broadcast(source.agg(value.alias(name))))
