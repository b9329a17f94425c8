"""Citation-audit analytics on Spark: typed relations and DataFrame operators over them."""
