"""promptveil: prompt safety and reversible redaction as plain Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from promptveil.settings import Settings

# functions sent to the executors carry their code, so the workers need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
