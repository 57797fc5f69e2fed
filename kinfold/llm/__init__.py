"""Operators for preparing training corpora. Nothing else in kinfold imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
