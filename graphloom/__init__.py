"""Property-graph analytics for software projects on Spark DataFrames."""

from importlib import import_module

__version__ = "0.2.0"
_EXPORTS = {"Graph": "api", "analyze": "api", "call": "api", "save": "api", "as_edges": "schemas", "as_nodes": "schemas"}
__all__ = [*_EXPORTS]


def __getattr__(name: str):
    """Exports are imported when first asked for, so that workers load no more than they use."""
    if name in _EXPORTS:
        return getattr(import_module(f"graphloom.{_EXPORTS[name]}"), name)
    raise AttributeError(f"module 'graphloom' has no attribute {name!r}")
