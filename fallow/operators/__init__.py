"""Panel operators on DataFrames."""
