"""Streaming variants of the batch tallies (an extension; the batch operators are the contract)."""
