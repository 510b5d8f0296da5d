"""End-to-end plans: fixtures, registered queries and their oracle SQL."""

import importlib

_MODULES = ["q_profile", "q_clean", "q_explore", "q_models"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"tessera.plans.{m}")
