"""Identities: seeds and handles derived by SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def derived_seed(*parts: Column) -> Column:
    """First 8 bytes, big-endian, of the SHA-256 of the parts joined by ``|``: an unsigned 64-bit number as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def opaque_handle(case_id: Column) -> Column:
    """A name for a case that tells evaluators nothing."""
    return F.concat(F.lit("case-"), F.substring(F.sha2(case_id, 256), 1, 16))


def document_identity(text: Column) -> Column:
    return F.sha2(text, 256)
