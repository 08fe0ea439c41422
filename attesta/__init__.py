"""Document-evidence analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
