"""Training-data operators: one module per operator, queries in ``queries``.

Nothing else in the library imports this subpackage. Functions that run in
tasks are pickled by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
