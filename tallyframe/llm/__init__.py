"""Training-data operators: search, archives, redaction, licences, decontamination, mixing,
language identification, page extraction, near-duplicates and chat formatting.

Nothing else in the library imports this subpackage.  Task functions travel to the executors by
value, so the executors need not have the library installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
