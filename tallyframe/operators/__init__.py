"""DataFrame -> DataFrame report operators, one module per report family."""
