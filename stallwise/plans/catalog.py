"""Imports every query module, so that the registry is filled."""

from __future__ import annotations

import importlib

MODULES = ("q_views", "q_columns", "q_market", "q_niches", "q_scoring", "q_validate", "q_backtest", "q_tables", "q_forum", "q_partners", "q_pages", "q_streams")


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"stallwise.plans.{name}")
