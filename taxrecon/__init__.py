"""Tax-invoice reconciliation and corpus preparation on Spark DataFrames."""
