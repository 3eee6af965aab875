"""Query catalogue over the driver's tables, and its SQL."""
