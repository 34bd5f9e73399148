"""Training-data operators: mixing, deduplication, decontamination, scoring, archives.

Each module holds one operator with its own interface; ``queries`` registers
the thin ``opN_*`` queries and their SQL.
"""
import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so a
# cluster needs no copy of the package on its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
