"""Spark jobs that turn collections of source files into clean, split and
packed data sets for code language models.

Every public function maps DataFrame to DataFrame or Column to Column. No module
owns a session; ``tarnmill.session`` offers a ready-made one.
"""

import sys

from pyspark import cloudpickle

# The small functions that run inside tasks travel with the job, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
