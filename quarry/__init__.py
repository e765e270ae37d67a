"""quarry: retrieval and text analytics written as plain Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function (or takes a few
DataFrames and returns one).  Queries, documents, ranked hits and metrics are
all tables, so each step is an ordinary Spark job optimised by Catalyst.
"""

__version__ = "0.1.0"
