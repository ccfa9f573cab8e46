"""Registered queries by subject."""

from importlib import import_module

MODULES = ("ledger", "scores", "queues", "verification", "texts", "resolution", "assessments", "observations")


def load_all() -> None:
    for m in MODULES:
        import_module(f"winnow.plans.{m}")
