"""Sales analytics and forecasting on Spark DataFrames.

The unit of work is a panel: many sales series told apart by any key columns.
Every operator takes a DataFrame and returns a lazy DataFrame.
"""

__version__ = "0.1.0"
