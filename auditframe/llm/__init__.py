"""Operators for training-data pipelines: filtering, dedup, mixing, packing and scans.

Nothing outside this subpackage imports it.  The functions that run in Python
workers are shipped by value, so executors need numpy, pyarrow, xxhash and
zstandard but not this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
