"""Tax-ledger reconciliation analytics, declared on Spark DataFrames."""
