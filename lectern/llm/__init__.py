"""Training-data operators: scans, tokens, fingerprints, classifiers, joins, packing and sharding.

Nothing else in the library imports this subpackage.  Its task-side functions travel to the
executors by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
