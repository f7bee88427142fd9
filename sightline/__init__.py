"""Spark jobs for geotagged species sightings and the knowledge around them."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# tasks carry the functions of this package with them, so executors need no installed copy
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
