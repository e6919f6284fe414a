"""claimloom: a claims-network analytics engine built on Spark DataFrames."""
