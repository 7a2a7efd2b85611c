"""Feature plans over the credit tables, one module per source table."""
