"""Training-data operators: quality, rules, near duplicates, substrings, token
counts, toxicity, packing, secrets, sharding, decontamination, spelling variants,
resampling and language-model scores.

Functions of this subpackage are shipped to Python workers by value, so the
executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
