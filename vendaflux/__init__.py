"""Sales analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame.  Nothing is computed
before an action, except where an operator says that it materialises its input.
"""

__version__ = "0.1.0"
