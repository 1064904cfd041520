"""Privacy-safe evidence retrieval and event analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: the functions of this package travel with the tasks that run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
