"""millrace: corpus analytics expressed as Spark plans."""
