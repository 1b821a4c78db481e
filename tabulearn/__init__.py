"""Statistical learning as table jobs on Spark: table in, small model, table out."""

import sys

from pyspark import cloudpickle

# Ship the small per-batch helpers inside each task, so that executors need
# no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
