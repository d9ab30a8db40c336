"""quarry: applied-analytics operators as lazy Spark DataFrame plans.

Every operator is a ``DataFrame -> DataFrame`` function built from the
DataFrame/SQL API so Catalyst can prune, push down and pick join strategies.
Actions happen only where an operator needs fitted values (model fits).
"""

__version__ = "0.1.0"
