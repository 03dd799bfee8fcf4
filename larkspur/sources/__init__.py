"""Files and partitioned tables."""
