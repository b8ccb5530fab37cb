"""Web-page and shop-page analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions of the few Python stages travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
