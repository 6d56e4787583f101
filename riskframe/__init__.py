"""Table operators and jobs for tabular risk modelling on Spark."""

import sys

from pyspark import cloudpickle

from riskframe.spec import HEART_SPEC, FeatureSpec

# Functions sent to executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["FeatureSpec", "HEART_SPEC"]
