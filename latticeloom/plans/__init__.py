"""Analyses and the registered queries."""


def load_queries():
    """The query registry with all query modules loaded."""
    import importlib
    import pkgutil

    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
