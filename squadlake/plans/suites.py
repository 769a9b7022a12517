"""The expectation suites of the five feeds, read from the JSON files beside this module."""

from __future__ import annotations

from importlib import resources

from squadlake.operators.quality import Suite, load_suites

ALL_SUITES = tuple(load_suites(resources.files("squadlake.plans") / "suite_files"))
CATAPULT, EMR_INJURIES, EMR_STATUS_UPDATES, FORCEDECK, NUTRITION, WELLNESS = ALL_SUITES


def suites_for(source: str) -> list[Suite]:
    return [s for s in ALL_SUITES if s.source == source]
