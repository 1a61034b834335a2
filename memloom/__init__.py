"""memloom: Spark operators for long-lived text knowledge and graph-shaped data.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
executed before the caller acts on the result, except where an iterative
algorithm has to cut its lineage (see :mod:`memloom.session`).
"""

__version__ = "0.1.0"
