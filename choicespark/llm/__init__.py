"""Operations of a training-data pipeline over document tables (one module per operator).

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded import in
``__spark_entry__.py`` refers to it.

Functions that run in tasks are sent by value, so workers need the libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
