"""The query catalogue: each query as a DataFrame, beside the SQL that gives the same rows."""
