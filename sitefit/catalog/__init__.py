"""Queries by section, each next to its check SQL."""

from __future__ import annotations

import importlib

SECTIONS = ("q_rules", "q_spatial", "q_compliance", "q_scalars", "q_plans", "q_area", "q_scoring", "q_text", "q_edits", "q_ingest", "q_clean", "q_planar", "q_planting")


def load():
    """Import every section and return the two registries."""
    for section in SECTIONS:
        importlib.import_module(f"sitefit.catalog.{section}")
    from sitefit.catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
