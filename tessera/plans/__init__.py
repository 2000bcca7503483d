"""Registered queries, one module per group of operators."""

import importlib
import pkgutil


def load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
