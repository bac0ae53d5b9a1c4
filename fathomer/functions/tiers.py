"""Source tiers: what a path says about the worth of its symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomer.functions.text import basename, extension

CODE, DOCS, VENDOR, LOW_SIGNAL = 1, 2, 3, 4
# The weight of a tier; a tier that is none of these weighs 1.
WEIGHTS = {CODE: 1.0, DOCS: 0.85, VENDOR: 0.7, LOW_SIGNAL: 0.5}
# Names and folders by tier.
_CHANGES = r"^changelog|^changes$|^history\.md$"
_GENERATED = r"^zz_generated|_generated\.|\.generated\.|^generated\.pb|\.pb\.go$|_string\.go$"
_VENDORED = ("vendor", "node_modules")
_SUPPORT = ("testdata", "test", "tests", "examples", "example", "docs", "doc", "hack")
_PROSE = (".md", ".rst", ".txt", ".yaml", ".yml", ".toml")


def has_component(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a folder of the path, or the whole path, has one of the names."""
    one = "|".join(names)
    return path.rlike(f"(^|/)({one})/|^({one})$")


def source_tier(path: Column) -> Column:
    """1 code, 2 docs, tests and configuration, 3 vendored, 4 generated and changelogs."""
    low = F.lower(path)
    base = basename(low)
    return (
        F.when(base.rlike(_CHANGES) | base.rlike(_GENERATED), LOW_SIGNAL)
        .when(has_component(low, _VENDORED), VENDOR)
        .when(has_component(low, _SUPPORT) | extension(path).isin(*_PROSE) | low.endswith("_test.go"), DOCS)
        .otherwise(CODE)
    )


def tier_weight(tier: Column) -> Column:
    out = F.lit(1.0)
    for key, weight in WEIGHTS.items():
        out = F.when(tier == key, weight).otherwise(out)
    return out
