"""Point-in-time analytics on event tapes, expressed as Spark DataFrame plans."""
