"""ticktide - news and price analytics for any number of symbols, written for Spark.

Everything is a function from DataFrame to DataFrame (or Column to Column); column
names are parameters and no list of symbols is built in.
"""
