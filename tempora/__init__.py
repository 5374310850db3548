"""tempora: temporal, spatial and evidence analytics on PySpark DataFrames."""
