"""Named query plans over the test tables, each with its SQL oracle."""

from . import registry
from . import analytics  # noqa: F401  (registers queries)


def queries():
    _load_all()
    return dict(registry.QUERIES)


def oracle_sql():
    _load_all()
    return dict(registry.ORACLES)


def _load_all():
    import importlib
    for mod in ("cleaning", "scalars", "io", "modeling"):
        try:
            importlib.import_module(f"{__name__}.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{mod}":
                raise
