"""papergrid: PySpark operators for scientific-literature tables."""
