"""Notice collection, search, document normalisation and extraction checks on Spark.

Every operator is a function from DataFrame (or Column) to DataFrame (or Column).
"""

from pyspark import cloudpickle

from . import operators, sources

# Python tasks (document parsing, archive expansion, paged reads, excerpt scans)
# travel by value, so executors need no copy of this package installed.
for _module in (
    operators.documents,
    operators.excerpts,
    sources.daily_csv,
    sources.paged_rest,
):
    cloudpickle.register_pickle_by_value(_module)
