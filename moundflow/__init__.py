"""moundflow: pitch analytics on Spark.

Functions from this package that run inside Python workers (the at-bat fold's
``mapInPandas`` / ``applyInPandasWithState`` steps) are pickled by value, so
executors need no installed copy of the package.
"""
import sys as _sys

try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: fall back to import on workers
    pass
