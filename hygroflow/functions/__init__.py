"""Column expressions: no function here triggers a job or moves a row."""
