"""Column expressions. None of them needs a Python UDF, and none depends on the session's time zone."""
