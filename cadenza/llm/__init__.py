"""Operators for preparing training text; nothing else imports this package.

Functions of this package travel to Python workers by value, so that a job
needs no copy of the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
