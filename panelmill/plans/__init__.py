"""Registered queries."""

import importlib
import pkgutil


def load():
    """(queries, SQL twins) of every module named q_*."""
    from panelmill.plans import registry

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return registry.QUERIES, registry.TWINS
