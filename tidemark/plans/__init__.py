"""Registered queries, one module per operator family."""


def load() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
