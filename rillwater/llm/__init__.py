"""Operators for training-data pipelines: deduplication, filters, packing, formatting.

Nothing else in the library imports this subpackage. Functions that run in
Python workers are shipped by value, so executors need not have it installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
