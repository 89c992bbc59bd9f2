"""Imports every query module so the registry is filled, and exposes it."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ["q_profile", "q_quality", "q_clean", "q_stats", "q_biblio", "q_eval", "q_prep", "q_models", "q_cluster", "q_predict", "q_io", "q_misc"]


def _load():
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")


def all_queries():
    _load()
    return QUERIES


def all_oracles():
    _load()
    return ORACLES


def flagship(spark, sf_dir):
    """SURVEY 7.1 slice: dirty orders -> replayable clean chain -> one-way
    ANOVA of order price by market segment (plus the group table)."""
    _load()
    from ..operators.stats import compare_groups
    from .q_clean import cleaned_orders
    df, _ops = cleaned_orders(spark, sf_dir)
    return compare_groups(df, "price", "segment", "anova")
