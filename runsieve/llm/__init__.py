"""Operators for preparing training data; nothing else in the library imports them.

Functions that run in tasks are sent by value, so executors need this package's
dependencies but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
