"""siltstone: schema-driven extraction of datasets from web pages, on Spark."""

import sys

from pyspark import cloudpickle

# what Python workers run travels with the query, so that no executor needs the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
