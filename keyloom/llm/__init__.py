"""Operators for training-data pipelines. Nothing else in the library imports this package."""

import keyloom
from pyspark import cloudpickle

# Functions that run inside tasks are sent with the tasks, so workers need not have the package.
cloudpickle.register_pickle_by_value(keyloom)
