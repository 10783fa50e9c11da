"""chronoframe: an event time series engine on PySpark DataFrames."""
