"""Recipes, selections and interventions."""

import copy

import pytest
from pyspark.sql import functions as F

from assay.operators import audits, evaluators, mutations, recipes

RECIPE = {
    "generation": {"base_seed": 7, "include_canonical_cases": True, "policies": {"valid": {"variants_per_fixture": 2, "operators": ["a", "b"]}}, "suite_name": "s"},
    "evaluation": {"evaluators": [{"name": "x", "version": "1", "config": {}}, {"name": "y", "version": "1", "config": {"k": 1}}]},
    "analysis": {"bootstrap_seed": 1, "bootstrap_resamples": 100, "bootstrap_ci": 0.95, "paired_comparison": True, "error_taxonomy": False},
}


def test_digests_say_what_they_depend_on():
    own = recipes.digests(RECIPE, "i", "s", "demo")
    assert len(set(own.values())) == 5 and all(len(v) == 64 for v in own.values())

    def moved(change, inputs="i", selection="s", domain="demo"):
        other = copy.deepcopy(RECIPE)
        change(other)
        now = recipes.digests(other, inputs, selection, domain)
        return {k.removesuffix("_hash") for k in own if own[k] != now[k]}

    assert moved(lambda r: r["generation"].update(base_seed=8)) == {"generation", "settings", "execution"}
    assert moved(lambda r: r["evaluation"]["evaluators"].reverse()) == {"evaluation", "settings", "execution"}
    assert moved(lambda r: r["analysis"].update(bootstrap_ci=0.9)) == {"analysis", "settings", "execution"}
    assert moved(lambda r: None, inputs="j") == moved(lambda r: None, selection="t") == {"execution"}
    assert len(moved(lambda r: None, domain="other")) == 5
    # the order of keys says nothing
    assert recipes.digests({s: dict(reversed(list(v.items()))) for s, v in RECIPE.items()}, "i", "s", "demo") == own
    for broken in ({"analysis": None}, {"analysis": RECIPE["analysis"] | {"more": 1}}, {"generation": {}}):
        with pytest.raises(ValueError):
            recipes.digests(RECIPE | broken, "i", "s", "demo")


def test_recipes_are_checked_against_the_tables_of_now():
    made = recipes.execution_recipe(RECIPE, "i", "s", "demo", {"root": "/a"}, {"head": "x"})
    other = recipes.execution_recipe(RECIPE, "i", "s", "demo", {"root": "/b"})
    assert {k for k in made if made[k] != other[k]} == {"locations", "metadata"} and recipes.recipe_problems(made, "i", "s", "demo") == []
    assert recipes.recipe_problems(made, "i", "t", "demo") == ["execution_hash", "selection_hash"]
    made["generation"] = made["generation"] | {"base_seed": 9}
    assert recipes.recipe_problems(made, "i", "s", "demo") == ["generation_hash", "settings_hash", "execution_hash"]


def test_selections_have_an_order(spark):
    rows = spark.createDataFrame([(k, f"c{k * 7 % 10}") for k in range(10)], "k int, case_id string")
    own = recipes.selection_digest(rows, ["k"])
    assert recipes.selection_digest(rows.repartition(4), ["k"]) == own != recipes.selection_digest(rows, ["case_id"])
    assert len({own, recipes.selection_digest(rows.where("k > 0"), ["k"]), recipes.selection_digest(rows.limit(0), ["k"])}) == 3


def test_interventions(spark):
    text = "# Gate skips a check\n\n## Summary\n\nMembers can read records of others, I think. The gate sucks.\n\n## Observed result\n\nAll of it is shown.\n"
    reports = spark.createDataFrame([("a", text), ("b", text.replace("Summary", "Overview")), ("c", "no report")], "case_id string, raw_text string")
    arms = audits.intervention_arms(reports).cache()
    assert arms.groupBy("arm").count().where("count <> 3").count() == 0 and audits.composite_problems(arms).count() == 0
    wrong = arms.withColumn("raw_text", F.when((F.col("arm") == "composite") & (F.col("case_id") == "b"), F.concat("raw_text", F.lit("x"))).otherwise(F.col("raw_text")))
    assert [r[0] for r in audits.composite_problems(wrong).collect()] == ["b"]
    got = {r["arm"]: r.asDict() for r in audits.intervention_audit(arms).collect()}
    assert set(got) == {"original", *audits.ARMS} and got["cue"]["text_changed"] == 2 and got["original"]["text_changed"] == got["original"]["decision_changed"] == 0
    # decisions that differ are counted against the original of the same case
    odd = evaluators.Evaluator("odd", (), lambda: evaluators._result(F.when(F.contains("raw_text", F.lit(mutations.PREAMBLE[:20])) & ~F.contains("raw_text", F.lit("Overview")), "accept").otherwise("reject"), F.lit(0.5), [F.lit(0.5)] * 5))
    moved = {r["arm"]: (r["accepted"], r["decision_changed"]) for r in audits.intervention_audit(arms, odd).collect()}
    assert moved == {"original": (0, 0), "style": (0, 0), "cue": (1, 1), "composite": (1, 1)}
