"""Document, conversation and event analytics on PySpark."""
