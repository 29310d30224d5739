"""Registered queries, grouped like the operators."""

from importlib import import_module

_MODULES = [
    "inventory", "links", "audit", "similarity", "tokens", "telemetry", "geometry", "checks", "components", "assets", "sources",
]


def load_all() -> None:
    for name in _MODULES:
        import_module(f"quiltlens.plans.{name}")
