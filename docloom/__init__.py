"""Document extraction and learning over DataFrames."""
