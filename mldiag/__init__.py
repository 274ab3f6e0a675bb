"""Dataset and model diagnostics as Spark jobs."""

import sys

from pyspark import cloudpickle

from mldiag.plans.workflows import compare, drift, evaluate, explore
from mldiag.sources.catalog import TableCatalog
from mldiag.sources.readers import load_images, read_table

__all__ = ["TableCatalog", "compare", "drift", "evaluate", "explore", "load_images", "read_table"]

# helper functions travel with their tasks, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
