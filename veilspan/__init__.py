"""Privacy-aware, multi-tenant telemetry processing as Spark jobs.

Every operator takes DataFrames and returns a lazy DataFrame.  Wall-clock reads are
explicit ``as_of`` arguments, so a batch gives the same answer whenever it is re-run.
"""

import sys

from pyspark import cloudpickle

# Ship the few Python helpers with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
