"""Operators of a training-data pipeline, one module each; nothing else imports this folder."""

import sys

from pyspark import cloudpickle

# Workers get this folder's code with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
