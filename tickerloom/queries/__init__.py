"""All registered queries; importing a module registers what it holds."""

from importlib import import_module

MODULES = ("lake", "features", "signals", "research", "portfolio", "trading", "sinks", "catalogue")


def load_all() -> None:
    for name in MODULES:
        import_module(f"tickerloom.queries.{name}")
