"""folioflow - document intelligence as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Arrow batch functions travel to the executors with their code, so a cluster
# needs no separate --py-files shipment of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
