"""castwise: choose and blend forecasting models per window, on Spark.

Every public operator is a function from DataFrames to a DataFrame over four
tables (samples, forecasts, labels, features).  See README.md for the map.
"""

__version__ = "0.1.0"
