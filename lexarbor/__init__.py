"""lexarbor: text-corpus curation and evaluation as PySpark DataFrame operators.

Python code that runs on executors is shipped by value, so a cluster needs
no installation of this package beside Spark, numpy and pyarrow.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
