"""brindle: dataflow operators and annotation analytics on PySpark DataFrames."""
