"""Identities of objects: SHA-256 of canonical JSON in a typed envelope."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value) -> bytes:
    """Sorted keys, no blanks, UTF-8; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def tagged_digest(kind: str, fields: dict, domain: str) -> str:
    return hashlib.sha256(canonical_json({"domain": domain, "type": kind, "version": 1, **fields})).hexdigest()


#: How canonical JSON writes characters that cannot stand in a string: the common ones first, then all others below a blank.
_ESCAPES = {c: json.dumps(c)[1:-1] for c in '\\"\n\r\t'}
_RARE_ESCAPES = {c: json.dumps(c)[1:-1] for c in map(chr, range(32)) if c not in _ESCAPES}


def json_string(text: Column) -> Column:
    """A text as :func:`canonical_json` writes it, without Python; the backslash goes first, as all others bring one in."""
    put = lambda t, escapes: reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), escapes.items(), t)
    common = put(text, _ESCAPES)
    rare = F.when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), put(common, _RARE_ESCAPES)).otherwise(common)
    return F.concat(F.lit('"'), rare, F.lit('"'))


def report_hash(text: Column, domain: str) -> Column:
    """Identity of report texts (not the hash of the file); texts stay in the JVM."""
    return F.sha2(F.concat(F.lit(f'{{"domain":{json.dumps(domain, ensure_ascii=False)},"text":'), json_string(text), F.lit(',"type":"report","version":1}')), 256)


def target_hash(expected_decision: Column, expected_dimensions: Column, domain: str) -> Column:
    """Identity of a target; no decision and a missing dimension stay distinct from any value."""

    def digest(decisions: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([tagged_digest("target", {"expected_decision": d, "expected_dimensions": dict(m or {})}, domain) for d, m in zip(decisions, dims)])

    return F.pandas_udf(digest, StringType())(expected_decision, expected_dimensions)


def input_hash(report: Column, target: Column, domain: str) -> Column:
    """Identity of a case's input from those of its report and target; hex digests need no escaping, so this stays in the JVM."""
    parts = [F.lit(f'{{"domain":{json.dumps(domain, ensure_ascii=False)},"report_hash":"'), report, F.lit('","target_hash":"'), target, F.lit('","type":"input","version":1}')]
    return F.sha2(F.concat(*parts), 256)
