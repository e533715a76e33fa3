"""Imports every query module and hands out the registry."""

from __future__ import annotations

import importlib

from palaver.plans import registry

MODULES = (
    "q_text", "q_rank", "q_corpus", "q_messages", "q_activity", "q_evaluate", "q_sinks", "q_stream",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"palaver.plans.{name}")


def queries():
    _load()
    return dict(registry.QUERIES)


def oracles():
    _load()
    return dict(registry.ORACLES)
