"""Training-data operators: deduplication, scoring, mixing, sharding, scans and decontamination over whole corpora.

Functions that run in tasks travel by value, so executors need no copy of this package.
"""

from pyspark import cloudpickle

import citeloom

cloudpickle.register_pickle_by_value(citeloom)
