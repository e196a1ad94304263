"""Reading tables and dumps."""
