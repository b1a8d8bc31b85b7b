"""Set-oriented operators of the store: DataFrame to DataFrame, without state."""
