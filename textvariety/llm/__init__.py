"""Operators of a training-data pipeline. Nothing else in the library imports this.

Python workers may start where the package is not on the path, so its functions
travel by value.
"""

from pyspark import cloudpickle

import textvariety

cloudpickle.register_pickle_by_value(textvariety)
