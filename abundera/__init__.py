"""abundera: quantitative entity-by-sample analytics and corpus preparation on PySpark.

Every relational operator is a ``DataFrame -> DataFrame`` function that stays
lazy; numerical solvers run as Arrow-batched grouped maps over groups whose
size is bounded by construction.  See ``README.md`` for the operator map.
"""

__version__ = "0.1.0"
