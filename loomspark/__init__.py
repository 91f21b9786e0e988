"""Corpus index, search and roll-up operators on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors get the code of this package with each task: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
