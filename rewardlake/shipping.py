"""Make worker-side Python code independent of how the package is installed.

Functions that run inside Python workers (``mapInPandas`` checkers, the
stateful stream reducer, the Python verifier adapter) are normally pickled
*by reference*, so every executor would need ``rewardlake`` importable.  The
modules that define them register here to be pickled *by value* instead:
the code travels with the task, and a job works whether the package was
shipped with ``--py-files``, installed, or only present on the driver.
"""

from __future__ import annotations

import sys


def ship_by_value(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark always ships it
        return
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
