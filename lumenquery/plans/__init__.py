"""SQL dialect and registered queries."""
