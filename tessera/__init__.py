"""tessera: notebook-corpus analytics as plain Spark DataFrame functions.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` (or a
Column expression) so Catalyst sees the whole plan.  Python workers are used
only where no built-in exists (Python syntax check, grouped diagram math).
"""

__version__ = "0.1.0"
