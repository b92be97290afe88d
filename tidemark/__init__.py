"""Version-history analytics on PySpark: bitemporal, hierarchical and reconciliation queries."""
