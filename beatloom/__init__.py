"""Beatloom: timeline, document and layout analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to DataFrames.  The ``llm``
subpackage adds operators for training-data pipelines; nothing outside it
imports it.
"""

__version__ = "0.1.0"
