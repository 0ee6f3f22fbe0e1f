"""Corpus operators: dedup, scans, formatting, decontamination, extraction and mixing for training data.

Their functions travel to the executors by value, so no executor needs this package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
