"""Search and text analytics over DataFrames."""
