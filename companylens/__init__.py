"""companylens: company-financials analytics on PySpark DataFrames."""
