"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. ``catalog`` holds one
query per operator; each operator's module holds its general interface.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so the machines of a
# cluster need numpy, pyarrow and the tokenizers, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
