"""The jobs. Each function takes and returns DataFrames."""
