"""Contact, customer and call list preparation on Spark DataFrames."""
