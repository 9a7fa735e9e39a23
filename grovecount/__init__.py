"""grovecount: orchard sighting analytics on Spark."""

import sys as _sys

# Functions of this package run inside Python workers (mapInPandas, the
# stateful window processor).  Pickling them by value ships their code with
# the task, so workers need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the hook
    pass
