"""tempora: honest, time-aware evaluation of classifiers as Spark DataFrame operators.

Every operator takes and returns DataFrames.  Work that SQL can express stays in
Catalyst (column expressions, aggregations, joins, windows); Spark ML fits models;
batched pandas functions are used only for random draws.
"""

__version__ = "0.1.0"
