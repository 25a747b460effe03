"""The operators applied to the driver tables."""
import importlib

MODULES = ["candidates", "targets", "scores", "reports", "models", "flows", "sources"]


def load():
    for name in MODULES:
        importlib.import_module(f"fleetsieve.workload.{name}")
