"""quillspark: retrieval, indexing and corpus processing expressed as Spark plans.

Python functions that run on executors are pickled by value, so executors need
Python with NumPy and Arrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
