"""fieldloom: a PySpark engine that turns documents into structured observation records and queries them."""
