"""Queries over the driver's tables, one per operator, each with the SQL whose result it must equal."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from checks import copying, intake, ledger, reporting, streams  # noqa: E402

MODULES = (reporting, ledger, intake, copying, streams)
