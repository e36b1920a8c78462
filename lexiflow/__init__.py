"""Text linguistics over DataFrames."""
