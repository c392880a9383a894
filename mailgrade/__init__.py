"""mailgrade: sort and study e-mail by priority with Spark DataFrames."""
