"""DataFrame -> DataFrame operators, one module per study step."""
