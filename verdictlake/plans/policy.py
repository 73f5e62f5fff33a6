"""Whose rule book the registered queries ask: the names of the synthetic tables."""

from __future__ import annotations

from ..config import Policy

SOURCES = tuple(f"src{k}" for k in range(20))
POLICY = Policy(
    group="Unit",
    units=("Unit Global", "Unit Home"),
    country="Home",
    documents={"internal": SOURCES[:4], "kyc": SOURCES[4:8], "credit": SOURCES[8:12], "investment": SOURCES[12:16], "filings": SOURCES[16:]},
)
