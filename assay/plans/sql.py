"""Oracle SQL: the bindings of :mod:`assay.plans.bindings` as common table expressions, written independently."""

from __future__ import annotations

_DEFAULT = "CASE {c} WHEN 'valid' THEN 'accept' WHEN 'invalid' THEN 'reject' ELSE 'needs_manual_review' END"


def _dims(prefix: str, seed: str) -> str:
    return ", ".join(f"(({seed}) + {k}) % 11 AS {prefix}{k}" for k in range(5))


REC = f"""
WITH ord AS (
  SELECT o_orderkey, o_custkey, substr(o_orderpriority, 1, 1) AS lvl,
         CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'invalid' ELSE 'review' END AS report_class
  FROM orders),
item AS (
  SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount, min(l_tax) AS l_tax,
         min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
kid AS (
  SELECT item.*, report_class,
         CASE l_linenumber WHEN 1 THEN 'professionalize_language' WHEN 2 THEN 'professionalize_style' WHEN 3 THEN 'confidence_overstatement'
           WHEN 4 THEN 'remove_reproduction_step' WHEN 5 THEN 'impossible_precondition' WHEN 6 THEN 'scope_expansion' ELSE 'add_irrelevant_detail' END AS op
  FROM item JOIN ord ON l_orderkey = o_orderkey),
plain AS (
  SELECT 'o' || o_orderkey AS case_id, 'canonical' AS case_kind, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS operator, report_class,
         {_DEFAULT.format(c='report_class')} AS target, o_orderkey AS k, {_dims('e', 'o_custkey')}, {_dims('a', 'o_orderkey')},
         CASE WHEN lvl IN ('1', '2') THEN 'accept' WHEN lvl = '3' THEN 'needs_manual_review' ELSE 'reject' END AS d1, CAST(o_custkey % 11 AS INTEGER) AS c1,
         CASE o_custkey % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'needs_manual_review' END AS d2, CAST(o_orderkey % 11 AS INTEGER) AS c2
  FROM ord
  UNION ALL
  SELECT 'l' || l_orderkey || '-' || l_linenumber, 'mutated', CASE WHEN l_orderkey % 10 = 0 THEN 'x' ELSE 'o' END || l_orderkey, op, report_class,
         CASE WHEN op = 'impossible_precondition' THEN 'reject'
              WHEN report_class = 'valid' AND op IN ('remove_reproduction_step', 'scope_expansion') THEN 'needs_manual_review'
              ELSE {_DEFAULT.format(c='report_class')} END,
         l_orderkey, {_dims('e', 'l_partkey')}, {_dims('a', '3 * l_suppkey')},
         CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'N' THEN 'needs_manual_review' ELSE 'reject' END, CAST(round(l_discount * 100) AS INTEGER),
         CASE l_linestatus WHEN 'F' THEN 'accept' ELSE 'reject' END, CAST(round(l_tax * 100) AS INTEGER)
  FROM kid),
rec AS (
  SELECT *, coalesce(decision = expected_decision, false) AS ok,
         case_kind = 'mutated' AND expected_decision IS NOT NULL AND expected_decision <> {_DEFAULT.format(c='report_class')} AS changing,
         case_kind = 'mutated' AND expected_decision IS NOT NULL AND expected_decision = {_DEFAULT.format(c='report_class')} AS preserving
  FROM (
    SELECT plain.* EXCLUDE (d1, c1, d2, c2, target), CASE WHEN k % 17 <> 0 THEN target END AS expected_decision, v.evaluator_name,
           CASE v.evaluator_name WHEN 'alpha' THEN d1 ELSE d2 END AS decision, CASE v.evaluator_name WHEN 'alpha' THEN c1 ELSE c2 END AS tenths
    FROM plain CROSS JOIN (VALUES ('alpha'), ('beta')) AS v(evaluator_name))),
kin AS (
  SELECT c.*, p.case_id AS p_id, p.decision AS p_decision, p.expected_decision AS p_expected, p.report_class AS p_class
  FROM rec c LEFT JOIN rec p ON c.parent_id = p.case_id AND c.evaluator_name = p.evaluator_name AND p.case_kind = 'canonical'
  WHERE c.case_kind = 'mutated')
"""

PAIRS = REC + """,
role AS (
  SELECT 'o' || o_orderkey AS case_id, CASE WHEN o_orderkey % 2 = 1 AND (o_orderkey // 2) % 9 = 0 THEN 'q' ELSE 'p' END || (o_orderkey // 2) AS pair_id, CASE WHEN o_orderkey % 2 = 0 THEN 'plain' ELSE 'polished' END AS pair_role
  FROM orders),
duo AS (
  SELECT evaluator_name, pair_id, count(*) AS members,
         max(CASE WHEN pair_role = 'plain' THEN decision END) AS a, max(CASE WHEN pair_role = 'polished' THEN decision END) AS b,
         max(CASE WHEN pair_role = 'plain' THEN expected_decision END) AS ea, max(CASE WHEN pair_role = 'polished' THEN expected_decision END) AS eb
  FROM rec JOIN role USING (case_id) WHERE case_kind = 'canonical' GROUP BY evaluator_name, pair_id)
"""

OUT = """
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repeat_index FROM events),
out AS (
  SELECT 'c' || (user_id % 3) AS condition, event_type || '-' || user_id AS case_id, CAST(repeat_index AS INTEGER) AS repeat_index, event_id,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'not_run' ELSE 'success' END AS status,
         CASE event_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'needs_manual_review' END AS decision,
         CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'schema' ELSE 'transport' END END AS error_kind,
         ((coalesce(CAST(round(value * 100) AS BIGINT), 0) % 10001) + 10001) % 10001 AS units
  FROM numbered)
"""

VOTES = """
WITH vote AS (
  SELECT l_orderkey, (l_linenumber - 1) % 3 + 1 AS model, min(l_returnflag) AS f, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
tally AS (
  SELECT 'o' || l_orderkey AS pair_id, count(*) AS voted,
         count(*) FILTER (f = 'A') AS qy, count(*) FILTER (f = 'N') AS qn, count(*) FILTER (p % 3 = 0) AS ay, count(*) FILTER (p % 3 = 1) AS an
  FROM vote GROUP BY ALL)
"""


def n(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


def ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"
