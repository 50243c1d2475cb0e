"""Order-N Markov text models on Spark, and operators for large training corpora."""

__version__ = "0.2.0"
__all__ = ["BuildConfig", "Generator", "Model", "build_model"]
_HOMES = {"Generator": "operators.generate", "BuildConfig": "sources.store", "Model": "sources.store", "build_model": "sources.store"}


def __getattr__(name: str):
    """The public classes, imported when they are first asked for: Python workers import
    this package, too, and need none of them."""
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(f".{_HOMES[name]}", __name__), name)
