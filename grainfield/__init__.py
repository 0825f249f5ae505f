"""grainfield: a PySpark-native engine for licence-aware web corpora.

Every operator is a function from DataFrames to a DataFrame; none holds a global session.
"""

__version__ = "0.1.0"
