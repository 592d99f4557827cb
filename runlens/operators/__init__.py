"""DataFrame -> DataFrame operators over the run table."""
