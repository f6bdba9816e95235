"""Composed pipelines and the registered query catalogue."""

import importlib

QUERY_MODULES = [
    "q_weekly",
    "q_functions",
    "q_windows",
    "q_quality",
    "q_clean",
    "q_features",
    "q_models",
    "q_validate",
    "q_eval",
    "q_apps",
]


def load_all() -> None:
    for m in QUERY_MODULES:
        importlib.import_module(f"{__name__}.{m}")
