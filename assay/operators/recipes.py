"""Identities of what a study was asked to do: digests of its settings, nested so that each says what it depends on.

A recipe is a small nested value that its author wrote; where it lies and what machine ran it are kept beside it and are part of no digest.
Identities of inputs come from tables, see :mod:`assay.operators.analysis` for digests that need no order and :func:`selection_digest` for one that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.identity import tagged_digest
from assay.operators.analysis import table_digest
from assay.operators.planning import ranked

SECTIONS = ("generation", "evaluation", "analysis")
# What each section consists of.
FIELDS = {
    "generation": ("base_seed", "include_canonical_cases", "policies", "suite_name"), "evaluation": ("evaluators",),
    "analysis": ("bootstrap_seed", "bootstrap_resamples", "bootstrap_ci", "paired_comparison", "error_taxonomy"),
}


def selection_digest(cases: DataFrame, order: list[str]) -> str:
    """The identity of ``cases`` in order of ``order``: the digest of the rows with their places, so another order is another selection."""
    return table_digest(ranked(cases.select(*dict.fromkeys((*order, *cases.columns))), order)).select(F.col("digest")).first()[0]


def digests(recipe: dict[str, dict], inputs: str, selection: str, domain: str) -> dict[str, str]:
    """Digests of the sections of a recipe, of its settings, and of its execution on ``inputs`` and ``selection``."""
    for section in SECTIONS:
        told = recipe.get(section)
        if not isinstance(told, dict) or set(told) != set(FIELDS[section]):
            raise ValueError(f"{section}: {', '.join(FIELDS[section])}")
    out = {f"{s}_hash": tagged_digest(s, recipe[s], domain) for s in SECTIONS}
    out["settings_hash"] = tagged_digest("settings", dict(out), domain)
    out["execution_hash"] = tagged_digest("execution", {"inputs_hash": inputs, "selection_hash": selection, "settings_hash": out["settings_hash"]}, domain)
    return out


def execution_recipe(recipe: dict[str, dict], inputs: str, selection: str, domain: str, locations: dict | None = None, metadata: dict | None = None) -> dict:
    """The whole recipe with its digests; ``locations`` and ``metadata`` travel with it."""
    made = {s: recipe[s] for s in SECTIONS if s in recipe}
    return made | digests(recipe, inputs, selection, domain) | {"inputs_hash": inputs, "selection_hash": selection, "locations": dict(locations or {}), "metadata": dict(metadata or {})}


def recipe_problems(made: dict, inputs: str, selection: str, domain: str) -> list[str]:
    """Names of the digests of an execution recipe that its sections, or the tables of now, do not give again."""
    now = digests({s: made.get(s) for s in SECTIONS}, inputs, selection, domain) | {"inputs_hash": inputs, "selection_hash": selection}
    return [k for k, v in now.items() if made.get(k) != v]
