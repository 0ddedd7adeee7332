"""DataFrame to DataFrame operators on metered series."""
