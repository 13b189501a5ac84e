"""A compact SQL dialect and data operators, lowered to Spark DataFrames."""
