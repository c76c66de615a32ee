"""Pipeline log analytics compiled to Spark DataFrame plans."""
