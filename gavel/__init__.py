"""gavel: Spark-native operators for text-quality rating and preference data.

Every public function takes and returns DataFrames (or Columns). Model calls stay
outside: they enter as a table of replies or as a caller-supplied function.
"""

__version__ = "0.1.0"
