"""Job-posting and crawl analytics on Spark DataFrames.

Every public function takes DataFrames and literals and returns a DataFrame.
Nothing collects to the driver; ``as_of`` replaces the wall clock so results
are reproducible, and ties are always broken by a unique column.
"""

import sys

from pyspark import cloudpickle

# the few Python helpers travel with their query, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
