"""Landing tables and the normalisation of what connectors fetch."""
