"""motifloom: time-series motif discovery on Spark DataFrames."""
