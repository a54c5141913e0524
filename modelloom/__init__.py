"""modelloom: analytics over corpora of optimization formulations, on DataFrames."""
