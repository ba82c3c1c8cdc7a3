"""Code-graph retrieval and analytics as Spark jobs.

Every operator takes *tables* of inputs (queries, pairs, sessions, questions) and returns a DataFrame, so a batch of
requests is one distributed plan rather than a loop of lookups.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors inside the plan, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
