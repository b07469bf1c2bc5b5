"""Queries of panels, ledgers and planning over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import audits, integrity, ledgers, metrics, panels, planning, repeats, resample
from assay.plans import bindings as b
from assay.plans.sql import OUT, REC, VOTES, n, ratio
from assay.registry import query
from assay.schema import is_preserving

VOTE = """
WITH item AS (SELECT l_orderkey, 'm' || ((l_linenumber - 1) % 3 + 1) AS model, min(l_returnflag) AS f, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
v AS (SELECT 'o' || l_orderkey AS pair_id, model, CASE f WHEN 'A' THEN 'yes' WHEN 'N' THEN 'no' ELSE 'uncertain' END AS quality_changed,
  CASE p % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'uncertain' END AS action_changed FROM item),
h AS (SELECT 'o' || o_orderkey AS pair_id, CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'uncertain' END AS hq, CASE o_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'uncertain' END AS ha FROM orders)
"""
CARD = """
WITH item AS (SELECT l_orderkey, 'm' || ((l_linenumber - 1) % 3 + 1) AS model, min(l_returnflag) AS f, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
v AS (SELECT 'o' || l_orderkey AS card_id, model, CASE f WHEN 'A' THEN 'accept' WHEN 'N' THEN 'needs_manual_review' ELSE 'reject' END AS action, CASE WHEN p % 2 = 0 THEN 'high' ELSE 'low' END AS confidence,
  s % 2 AS c1, (p + s) % 2 AS c2 FROM item),
r AS (SELECT 'o' || o_orderkey AS card_id, CASE o_orderstatus WHEN 'F' THEN 'accept' WHEN 'O' THEN 'reject' ELSE 'needs_manual_review' END AS ra, CASE WHEN o_custkey % 2 = 0 THEN 'high' ELSE 'low' END AS rc,
  o_custkey % 2 AS r1, o_orderkey % 2 AS r2 FROM orders),
vr AS (SELECT * FROM v JOIN r USING (card_id))
"""


def _yes_no(number):
    return F.when(number % 3 == 0, "yes").when(number % 3 == 1, "no").otherwise("uncertain")


def _human(spark, sf_dir):
    return b.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("pair_id"), _yes_no(F.col("o_orderkey")).alias("quality_changed"), _yes_no(F.col("o_custkey")).alias("action_changed"))


def _claims(first, second):
    said = lambda x: F.when(x % 2 == 0, "supported").otherwise("refuted")
    return F.create_map(F.lit("c1"), said(first), F.lit("c2"), said(second))


def _cards(spark, sf_dir):
    """(votes, reference) of cards."""
    lines = b.read(spark, sf_dir, "lineitem")
    lines = b.dealt(lines.withColumn("card_id", F.concat(F.lit("o"), "l_orderkey")), lines.count(), "card_id")  # once for the votes, the reference and what is grouped by card
    items = lines.groupBy("card_id", ((F.col("l_linenumber") - 1) % 3 + 1).alias("m")).agg(F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    level = lambda x: F.when(x % 2 == 0, "high").otherwise("low")
    votes = items.select(
        "card_id", F.concat(F.lit("m"), "m").alias("model"), F.when(F.col("f") == "A", "accept").when(F.col("f") == "N", "needs_manual_review").otherwise("reject").alias("action"),
        level(F.col("p")).alias("confidence"), _claims(F.col("s"), F.col("p") + F.col("s")).alias("claims"),
    )
    reference = b.read(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), "o_orderkey").alias("card_id"), F.when(F.col("o_orderstatus") == "F", "accept").when(F.col("o_orderstatus") == "O", "reject").otherwise("needs_manual_review").alias("action"),
        level(F.col("o_custkey")).alias("confidence"), _claims(F.col("o_custkey"), F.col("o_orderkey")).alias("claims"),
    )
    return votes, reference


@query(CARD + f"""SELECT model, count(*) AS valid_votes, {n('action = ra')} AS action_matches, {n('confidence = rc')} AS confidence_matches, 2 * count(*) AS claims, {n('c1 = r1')} + {n('c2 = r2')} AS claim_matches FROM vr GROUP BY model""")
def reference_agreement(spark, sf_dir):
    return panels.reference_agreement(*_cards(spark, sf_dir))


@query(CARD + "SELECT model, ra || ' -> ' || action AS transition, count(*) AS n FROM vr GROUP BY ALL")
def reference_transitions(spark, sf_dir):
    return panels.reference_transitions(*_cards(spark, sf_dir))


@query(CARD + f"""SELECT count(*) AS complete_cards, {n('a')} AS action_disputes, {n('c')} AS claim_disputes FROM (SELECT card_id, bool_or(action <> ra) AS a, bool_or(c1 <> r1 OR c2 <> r2) AS c FROM vr GROUP BY card_id HAVING count(*) = 3)""")
def disputed_cards(spark, sf_dir):
    return panels.disputed_cards(*_cards(spark, sf_dir), 3)


@query(VOTE + f"SELECT model, count(*) AS valid_pairs, {n('quality_changed = hq')} AS quality_changed_matches, {n('action_changed = ha')} AS action_changed_matches FROM v JOIN h USING (pair_id) GROUP BY model")
def human_model_agreement(spark, sf_dir):
    return panels.human_model_agreement(_human(spark, sf_dir), b.votes(spark, sf_dir))


_CAT = "CASE WHEN {q} NOT IN ('yes', 'no') OR {a} NOT IN ('yes', 'no') THEN 'uncertain' WHEN {q} = 'yes' AND {a} = 'yes' THEN 'both' WHEN {q} = 'yes' THEN 'quality_only' WHEN {a} = 'yes' THEN 'action_only' ELSE 'neither' END"


@query(VOTE + f""", m AS (SELECT pair_id, CASE WHEN {n("quality_changed = 'yes'")} >= 2 THEN 'yes' WHEN {n("quality_changed = 'no'")} >= 2 THEN 'no' END AS q,
CASE WHEN {n("action_changed = 'yes'")} >= 2 THEN 'yes' WHEN {n("action_changed = 'no'")} >= 2 THEN 'no' END AS a FROM v GROUP BY pair_id HAVING count(*) = 3)
SELECT count(*) AS complete_pairs, count(q) AS quality_changed_definite, {n('q = hq')} AS quality_changed_matches, count(a) AS action_changed_definite, {n('a = ha')} AS action_changed_matches,
{n('q IS NOT NULL AND a IS NOT NULL')} AS definite_categories, {n(f"q IS NOT NULL AND a IS NOT NULL AND ({_CAT.format(q='q', a='a')}) = ({_CAT.format(q='hq', a='ha')})")} AS category_matches FROM m JOIN h USING (pair_id)""")
def human_majority_agreement(spark, sf_dir):
    return panels.human_majority_agreement(_human(spark, sf_dir), b.votes(spark, sf_dir))


@query(VOTES + """, c AS (SELECT pair_id, CASE WHEN voted < 3 THEN 'incomplete' WHEN (qy < 2 AND qn < 2) OR (ay < 2 AND an < 2) THEN 'uncertain'
WHEN qy >= 2 AND ay >= 2 THEN 'both' WHEN qy >= 2 THEN 'quality_only' WHEN ay >= 2 THEN 'action_only' ELSE 'neither' END AS category FROM tally)
SELECT o_orderpriority AS operator, category, count(*) AS n FROM c JOIN orders ON pair_id = 'o' || o_orderkey GROUP BY ALL""")
def category_by_operator(spark, sf_dir):
    pairs = b.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("operator"))
    return panels.category_counts(repeats.vote_majority(b.votes(spark, sf_dir)), pairs)


@query("""WITH v AS (SELECT DISTINCT l_orderkey, (l_linenumber - 1) % 3 + 1 AS m FROM lineitem)
SELECT 'o' || o_orderkey AS pair_id, 'm' || k AS model, CASE WHEN m IS NOT NULL THEN 'success' WHEN k = 3 AND o_orderkey % 2 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'invalid_or_transport_error' ELSE 'http_error' END ELSE 'not_run' END AS status
FROM orders CROSS JOIN (VALUES (1), (2), (3)) AS t(k) LEFT JOIN v ON l_orderkey = o_orderkey AND m = k""")
def panel_matrix(spark, sf_dir):
    orders = b.read(spark, sf_dir, "orders")
    pairs = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("pair_id"))
    tries = orders.where("o_orderkey % 2 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("pair_id"), F.lit("m3").alias("model"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"), "o_custkey")
    last = F.when(F.col("o_custkey") % 2 == 0, "invalid_or_transport_error").otherwise("http_error")
    return panels.panel_matrix(pairs, ["m1", "m2", "m3"], b.votes(spark, sf_dir), tries.withColumn("status", F.when(F.col("attempt") == 1, "timeout").otherwise(last)))


@query(OUT + f""", ran AS (SELECT DISTINCT case_id, repeat_index, decision FROM out WHERE status = 'success'),
c AS (SELECT DISTINCT case_id, split_part(case_id, '-', 1) AS operator, CASE WHEN case_id LIKE 'error%' THEN 'canonical' ELSE 'mutated' END AS case_kind FROM out),
s AS (SELECT case_id, count(DISTINCT repeat_index) AS r, count(DISTINCT decision) AS d FROM ran GROUP BY case_id)
SELECT case_kind, operator, count(*) AS eligible, {n('r >= 3')} AS complete, {n('r >= 3 AND d > 1')} AS changed FROM c LEFT JOIN s USING (case_id) GROUP BY ALL""")
def repeat_agreement(spark, sf_dir):
    out = b.outcomes(spark, sf_dir)
    cases = out.select("case_id").distinct().select("case_id", F.split("case_id", "-")[0].alias("operator"), F.when(F.col("case_id").startswith("error"), "canonical").otherwise("mutated").alias("case_kind"))
    return panels.repeat_agreement(cases, out.where("status = 'success'").select("case_id", "repeat_index", "decision"))


@query(OUT + f""", ran AS (SELECT case_id, repeat_index, decision, split_part(case_id, '-', 2) AS u FROM out WHERE status = 'success'),
e AS (SELECT case_id, 'click-' || split_part(case_id, '-', 2) AS parent_id FROM (SELECT DISTINCT case_id FROM out) WHERE case_id NOT LIKE 'click-%'),
p AS (SELECT a.repeat_index, count(*) AS paired, {n('a.decision <> b.decision')} AS changed FROM e JOIN ran a ON a.case_id = e.case_id JOIN ran b ON b.case_id = e.parent_id AND a.repeat_index = b.repeat_index GROUP BY ALL)
SELECT CAST(r.repeat_index AS INTEGER) AS repeat_index, (SELECT count(*) FROM e) AS eligible, coalesce(paired, 0) AS paired, (SELECT count(*) FROM e) - coalesce(paired, 0) AS missing_pairs, coalesce(changed, 0) AS changed
FROM (SELECT DISTINCT repeat_index FROM ran) r LEFT JOIN p ON p.repeat_index = r.repeat_index""")
def repeat_drift(spark, sf_dir):
    out = b.outcomes(spark, sf_dir)
    user = F.split("case_id", "-")[1]
    cases = out.select("case_id").distinct().select("case_id", F.concat(F.lit("click-"), user).alias("parent_id"), (~F.col("case_id").startswith("click-")).alias("preserving"))
    return panels.repeat_drift(cases, out.where("status = 'success'").select("case_id", "repeat_index", "decision"))


@query(REC + f"""SELECT operator, {n('preserving')} AS preserving, {n("preserving AND operator IN ('remove_reproduction_step', 'scope_expansion')")} AS negative_delta, CAST(0 AS BIGINT) AS removes_required_version
FROM (SELECT DISTINCT case_id, operator, preserving FROM rec) WHERE preserving GROUP BY operator""")
def preserving_inventory(spark, sf_dir):
    specs = spark.createDataFrame([(o, o in ("remove_reproduction_step", "scope_expansion")) for o in b.OPERATORS], "operator string, negative_delta boolean")
    # what is left out goes before the rows of a case meet; all of them say the same
    rows = b.records(spark, sf_dir).where(is_preserving()).select("case_id", "case_kind", "parent_id", "operator", "report_class", "expected_decision")
    cases = b.dealt(rows, b.most_records(spark, sf_dir), "case_id").distinct()
    return panels.preserving_inventory(cases.withColumn("required_versions", F.lit(True)), specs)


@query("""SELECT c.conv_id || '-' || c.turn AS case_id, CASE WHEN s THEN c.text ELSE p.text END AS a, CASE WHEN s THEN p.text ELSE c.text END AS b, s AS swapped
FROM (SELECT *, CAST(('0x' || substr(sha256(conv_id || '-' || turn), 64, 1)) AS INTEGER) % 2 = 1 AS s FROM conversations) c JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1""")
def text_pairs(spark, sf_dir):
    c = b.read(spark, sf_dir, "conversations")
    name = lambda turn: F.concat("conv_id", F.lit("-"), turn)
    children = c.select(name(F.col("turn").cast("string")).alias("case_id"), name((F.col("turn") - 1).cast("string")).alias("parent_id"), "text")
    return panels.text_pairs(children, children.select("case_id", "text"))


@query(OUT + """, o2 AS (SELECT case_id, CAST(repeat_index + CASE WHEN event_id % 37 = 0 THEN 50 ELSE 0 END AS INTEGER) AS repeat_index, CASE WHEN event_id % 41 = 0 THEN 'odd' ELSE status END AS status, event_id FROM out),
o3 AS (SELECT * FROM o2 UNION ALL SELECT * FROM o2 WHERE event_id % 43 = 0),
seen AS (SELECT case_id, repeat_index, count(*) AS n, count(*) FILTER (status = 'odd') AS bad FROM o3 GROUP BY ALL),
plan AS (SELECT DISTINCT case_id, CAST(r AS INTEGER) AS repeat_index FROM o3 CROSS JOIN range(6) AS t(r))
SELECT case_id, repeat_index, 'missing' AS problem FROM plan ANTI JOIN seen USING (case_id, repeat_index) UNION ALL SELECT case_id, repeat_index, 'foreign' FROM seen ANTI JOIN plan USING (case_id, repeat_index)
UNION ALL SELECT case_id, repeat_index, 'duplicate' FROM seen WHERE n > 1 UNION ALL SELECT case_id, repeat_index, 'malformed' FROM seen WHERE bad > 0""")
def outcome_problems(spark, sf_dir):
    out = b.outcomes(spark, sf_dir).withColumns({"repeat_index": F.col("repeat_index") + F.when(F.col("event_id") % 37 == 0, 50).otherwise(0), "status": F.when(F.col("event_id") % 41 == 0, "odd").otherwise(F.col("status"))})
    out = out.unionByName(out.where("event_id % 43 = 0"))
    return ledgers.outcome_problems(out, out.select("case_id"), 6)


@query("""WITH c AS (SELECT 'o' || o_orderkey AS case_id, o_orderkey AS k, e.* FROM orders CROSS JOIN (VALUES ('alpha', 5), ('beta', 1000000007)) AS e(evaluator_name, m)),
s AS (SELECT * FROM c WHERE k % m <> 0 UNION ALL SELECT * FROM c WHERE evaluator_name = 'alpha' AND k % 77 = 1 AND k % 5 <> 0), f AS (SELECT * FROM c WHERE k % m = 0 OR (evaluator_name = 'alpha' AND k % 35 = 1) OR (evaluator_name = 'beta' AND k = 0)),
slot AS (SELECT evaluator_name, case_id, sum(a) AS a, sum(b) AS b FROM (SELECT evaluator_name, case_id, 1 AS a, 0 AS b FROM s UNION ALL SELECT evaluator_name, case_id, 0, 1 FROM f) GROUP BY ALL),
t AS (SELECT evaluator_name, (SELECT count(DISTINCT o_orderkey) FROM orders) AS planned, count(*) FILTER (a > 0) AS scored, count(*) FILTER (b > 0) AS failed, count(*) FILTER (a > 0 AND b > 0) AS clashing, count(*) FILTER (a > 1 OR b > 1) AS repeated, count(*) AS met FROM slot GROUP BY evaluator_name)
SELECT evaluator_name, planned, scored, failed, clashing, planned - met AS missing, CAST(0 AS BIGINT) AS foreign, repeated, clashing + repeated + planned - met = 0 AND planned = scored + failed AS complete FROM t""")
def accounting(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = b.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("case_id"))
    alpha, beta = (orders.withColumn("evaluator_name", F.lit(e)) for e in ("alpha", "beta"))
    scored = alpha.where(k % 5 != 0).unionByName(alpha.where((k % 77 == 1) & (k % 5 != 0))).unionByName(beta.where(k % 1000000007 != 0))
    failed = alpha.where((k % 5 == 0) | (k % 35 == 1)).unionByName(beta.where(k % 1000000007 == 0))
    return ledgers.accounting(scored, failed, orders)


_LEDGER = """WITH i AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS l FROM lineitem),
led AS (SELECT 'l' || k || '-' || l AS case_id, CASE l WHEN 1 THEN 'written' WHEN 2 THEN 'written' WHEN 3 THEN 'no_op' WHEN 4 THEN 'duplicate' WHEN 5 THEN 'safety_blocked' WHEN 6 THEN 'error' ELSE 'lost' END AS status, k, l FROM i),
idx AS (SELECT case_id FROM led WHERE l = 1 OR (l = 2 AND k % 50 <> 0) OR (l = 3 AND k % 60 = 0))
"""


def _ledger(spark, sf_dir):
    """(ledger, index) of line items."""
    rows = b.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l")).distinct()
    status = F.coalesce(F.get(F.array(*map(F.lit, ("written", "written", "no_op", "duplicate", "safety_blocked", "error"))), (F.col("l") - 1).cast("int")), F.lit("lost"))
    led = rows.select(F.concat(F.lit("l"), "k", F.lit("-"), "l").alias("case_id"), status.alias("status"), "k", "l")
    index = led.where("l = 1 or (l = 2 and k % 50 <> 0) or (l = 3 and k % 60 = 0)").select("case_id")
    canonical = b.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("case_id"))
    return led.select("case_id", "status"), ledgers.index_of(index, canonical)


@query(_LEDGER + """SELECT case_id, 'unknown_status' AS problem FROM led WHERE status = 'lost' UNION ALL SELECT case_id, 'not_indexed' FROM led ANTI JOIN idx USING (case_id) WHERE status = 'written'
UNION ALL SELECT idx.case_id, 'not_written' FROM idx JOIN led USING (case_id) WHERE status <> 'written'""")
def materialization_problems(spark, sf_dir):
    return ledgers.materialization_problems(*_ledger(spark, sf_dir))


@query(_LEDGER + "SELECT (SELECT count(*) FROM led) AS planned, (SELECT count(*) FROM led WHERE status = 'written') AS written, (SELECT count(*) FROM idx) + (SELECT count(*) FROM orders) AS selected, (SELECT count(*) FROM orders) AS canonical_included")
def materialization_totals(spark, sf_dir):
    return ledgers.materialization_totals(*_ledger(spark, sf_dir))


@query(_LEDGER + "SELECT status, count(*) AS n FROM led GROUP BY status")
def ledger_tallies(spark, sf_dir):
    return planning.ledger_tallies(_ledger(spark, sf_dir)[0])


@query("""SELECT 'o' || o_orderkey AS case_id, 'mutated' AS kind, 'c' || c_custkey AS fixture_id, c_mktsegment AS report_class FROM orders JOIN customer ON o_custkey = c_custkey""")
def build_cases(spark, sf_dir):
    index = b.read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("case_id"), F.lit("mutated").alias("kind"), F.concat(F.lit("c"), "o_custkey").alias("fixture_id"))
    fixtures = b.read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("fixture_id"), F.col("c_mktsegment").alias("report_class"))
    return ledgers.build_cases(index, fixtures)


@query("""WITH f AS (SELECT event_type AS evaluator_name, 'c' || (user_id % 50) AS case_id, CAST(event_id % 3 - 1 AS INTEGER) AS repeat_index, CASE WHEN event_id % 11 = 0 THEN 'odd' WHEN event_id % 2 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 13 <> 0 THEN 'timeout' END AS error_kind FROM events)
SELECT evaluator_name, case_id, CASE WHEN repeat_index < 0 OR status = 'odd' THEN 'malformed' ELSE 'no_error_kind' END AS problem FROM f WHERE repeat_index < 0 OR status = 'odd' OR (status = 'failed' AND error_kind IS NULL)
UNION ALL SELECT evaluator_name, case_id, 'duplicate' FROM f GROUP BY evaluator_name, case_id, repeat_index HAVING count(*) > 1
UNION ALL SELECT evaluator_name, case_id, 'unknown_evaluator' FROM f WHERE evaluator_name = 'signup'
UNION ALL SELECT evaluator_name, case_id, 'also_scored' FROM f WHERE status = 'failed' AND evaluator_name = 'click' AND CAST(substr(case_id, 2) AS INTEGER) < 5""")
def failure_ledger_problems(spark, sf_dir):
    e = b.read(spark, sf_dir, "events")
    k = F.col("event_id")
    failures = e.select(
        F.col("event_type").alias("evaluator_name"), F.concat(F.lit("c"), (F.col("user_id") % 50).cast("string")).alias("case_id"), (k % 3 - 1).cast("int").alias("repeat_index"),
        F.when(k % 11 == 0, "odd").when(k % 2 == 0, "failed").otherwise("success").alias("status"), F.when(k % 13 != 0, "timeout").alias("error_kind"),
    )
    records = spark.range(5).select(F.lit("click").alias("evaluator_name"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("case_id"))
    return ledgers.failure_problems(failures, records, e.where("event_type <> 'signup'").select(F.col("event_type").alias("evaluator_name")))


@query("""WITH c AS (SELECT c_custkey, c_mktsegment, 'p' || (c_custkey % 7) AS pair_id FROM customer),
p AS (SELECT c_custkey, CASE WHEN pair_id IN ('p1', 'p2') THEN pair_id ELSE c_mktsegment END AS policy FROM c) SELECT policy, count(*) AS fixtures, count(*) * CASE WHEN policy LIKE 'p_' THEN 2 ELSE 3 END AS cases FROM p GROUP BY policy""")
def policy_estimates(spark, sf_dir):
    customers = b.read(spark, sf_dir, "customer")
    fixtures = customers.select(F.concat(F.lit("c"), "c_custkey").alias("fixture_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 7).cast("string")).alias("pair_id"), F.col("c_mktsegment").alias("report_class"))
    policies = customers.select(F.col("c_mktsegment").alias("policy")).distinct().withColumn("variants", F.lit(3)).unionByName(spark.createDataFrame([("p1", 2), ("p2", 2)], "policy string, variants int"))
    return planning.estimated_cases(planning.with_policy(fixtures, policies), policies)


@query("""SELECT 'l' || l_orderkey || '-' || l_linenumber AS case_id, l_suppkey AS ordinal, CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) > 1 THEN 'duplicate'
WHEN l_partkey % 11 = 0 THEN 'error' WHEN l_partkey % 7 = 0 OR l_partkey % 13 = 0 THEN 'no_op' WHEN l_partkey % 5 = 0 THEN 'safety_blocked' ELSE 'written' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)""")
def materialization_status(spark, sf_dir):
    rows = b.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").distinct()
    p = F.col("l_partkey")
    applied = rows.select(
        F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("case_id"), F.struct("l_suppkey", "l_partkey").alias("ordinal"), F.when(p % 11 == 0, "failed").alias("error"), F.when(p % 7 == 0, "nothing to do").alias("note"),
        F.when(p % 13 == 0, "same").otherwise("text").alias("text"), F.lit("same").alias("parent_text"), (p % 5 == 0).alias("unsafe"),
    )
    return planning.materialization_status(applied).select("case_id", F.col("ordinal.l_suppkey").alias("ordinal"), "status")


@query("""SELECT c_custkey, round(greatest(0, least(1, (c_custkey % 11) / 10 + 0.25)), 3) AS scope, round(greatest(0, least(1, (c_custkey % 7) / 10 - 0.4)), 3) AS evidence, round(0.5 + 0.125, 3) AS missing, (c_custkey % 3) / 10 AS kept FROM customer""")
def dimension_deltas(spark, sf_dir):
    k = F.col("c_custkey")
    base = F.create_map(F.lit("scope"), (k % 11) / 10.0, F.lit("evidence"), (k % 7) / 10.0, F.lit("kept"), (k % 3) / 10.0)
    out = planning.dimension_deltas(base, {"scope": 0.25, "evidence": -0.4, "missing": 0.125})
    return b.read(spark, sf_dir, "customer").select("c_custkey", *(out[d].alias(d) for d in ("scope", "evidence", "missing", "kept")))


@query(REC + "SELECT CASE WHEN count(*) > 0 THEN 'applied' ELSE 'skipped' END AS pair_merge, count(*) AS mapped FROM (SELECT DISTINCT coalesce(parent_id, case_id) AS c FROM rec) WHERE c LIKE 'o%' AND substr(c, 2) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)")
def pair_merge(spark, sf_dir):
    return resample.pair_merge(b.records(spark, sf_dir), b.pair_roles(spark, sf_dir))


@query(None)
def flip_interval(spark, sf_dir):
    """Share of unstable cases, users drawn whole; the tests compare it with a brute-force version."""
    variance = repeats.case_variance(b.outcomes(spark, sf_dir)).where("successes >= 2")
    return resample.flip_interval(variance.select(F.split("case_id", "-")[1].alias("group"), F.col("flip").cast("int").alias("flip")))


@query("""WITH s AS (SELECT 'o' || o_orderkey AS pair_id, o_orderkey AS k FROM orders), e AS (SELECT 'o' || o_orderkey AS pair_id FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT 'x' || c_custkey FROM customer WHERE c_custkey % 50 = 0),
two AS (SELECT * FROM s UNION ALL SELECT * FROM s WHERE k % 20 = 1)
SELECT pair_id, x AS issue FROM (SELECT pair_id, unnest([CASE WHEN k % 4 = 3 THEN 'quality_changed is no answer' END, CASE WHEN k % 7 = 0 THEN 'action_changed is no answer' END, CASE WHEN k % 11 = 0 THEN 'no rationale' END]) AS x FROM two) WHERE x IS NOT NULL
UNION ALL SELECT pair_id, 'unexpected' FROM s WHERE k % 10 = 3 UNION ALL SELECT pair_id, 'missing' FROM e WHERE pair_id LIKE 'x%' UNION ALL SELECT pair_id, 'repeated' FROM s WHERE k % 20 = 1""")
def sheet_issues(spark, sf_dir):
    k = F.col("o_orderkey")
    orders = b.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("o"), "o_orderkey").alias("pair_id"))
    sheet = orders.unionByName(orders.where(k % 20 == 1)).select(
        "pair_id", F.when(k % 4 == 3, "maybe").when(k % 4 == 0, "yes").otherwise("no").alias("quality_changed"), F.when(k % 7 != 0, "uncertain").alias("action_changed"), F.when(k % 11 == 0, " ").otherwise("seen").alias("rationale"),
    )
    expected = orders.where(k % 10 != 3).select("pair_id").unionByName(b.read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("x"), "c_custkey").alias("pair_id")))
    return integrity.sheet_issues(sheet, expected)


@query(REC + f"""SELECT metric, max(v) FILTER (evaluator_name = 'alpha') AS alpha, max(v) FILTER (evaluator_name = 'beta') AS beta FROM (
SELECT evaluator_name, 'total_cases' AS metric, CAST({n('expected_decision IS NOT NULL')} AS DOUBLE) AS v FROM rec GROUP BY evaluator_name UNION ALL SELECT evaluator_name, 'correct_cases', CAST({n('ok')} AS DOUBLE) FROM rec GROUP BY evaluator_name
UNION ALL SELECT evaluator_name, 'unscored_cases', CAST({n('expected_decision IS NULL')} AS DOUBLE) FROM rec GROUP BY evaluator_name UNION ALL SELECT evaluator_name, 'decision_accuracy', {ratio(n('ok'), n('expected_decision IS NOT NULL'))} FROM rec GROUP BY evaluator_name) GROUP BY metric""")
def comparison(spark, sf_dir):
    return audits.comparison(metrics.decision_accuracy(b.records(spark, sf_dir)), ["alpha", "beta"])
