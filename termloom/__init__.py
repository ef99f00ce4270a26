"""termloom: terminology search, evidence analytics and data preparation on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
