"""Column expressions: nothing here runs a job or touches Python rows."""
