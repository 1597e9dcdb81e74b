"""The build as a list of named stages over tables, and the choice between two pose tracks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The order in which stages run.
ORDER = ["prep", "tag", "canonicalise", "detect", "poses", "lift", "scale", "trajectories", "collapse", "relations", "places", "describe", "check", "events"]


@dataclass
class Stage:
    """makes(tables) gives a DataFrame; optional stages may fail without ending the build."""

    name: str
    makes: Callable[[dict[str, DataFrame]], DataFrame]
    optional: bool = False


@dataclass
class Build:
    stages: list[Stage]
    failed: dict[str, str] = field(default_factory=dict)

    def run(self, tables: dict[str, DataFrame], only: list[str] | None = None, save: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """Runs the stages in order; save(name, df) writes a stage's table and gives it back, which cuts its lineage."""
        tables = dict(tables)
        for stage in self.stages:
            if only is not None and stage.name not in only:
                continue
            try:
                made = stage.makes(tables)
                tables[stage.name] = save(stage.name, made) if save else made
            except Exception as e:
                if not stage.optional:
                    raise
                self.failed[stage.name] = f"{type(e).__name__}: {e}"
        return tables


def chosen_poses(first: DataFrame, second: DataFrame, gate: DataFrame, keys: list[str]) -> DataFrame:
    """The first backend's poses for clips whose gate passes, the second's for the others."""
    passed = gate.filter("verdict = 'PASS'").select(*keys)
    return first.join(passed, keys, "left_semi").unionByName(second.join(passed, keys, "left_anti"))


def units(scale_source: Column) -> Column:
    from keepsight.sources.readers import is_metric

    return F.when(is_metric(scale_source), "m").otherwise("scene units")
