"""Operations of a pipeline that prepares training text, and their registered queries."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with what they use of this package,
# so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
