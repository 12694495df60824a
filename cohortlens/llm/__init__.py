"""Operators of a training-data pipeline.

Their functions travel to the workers by value, so a cluster needs no copy of this
package on its nodes.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
