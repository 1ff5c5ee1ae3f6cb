"""tessella: text-corpus analytics on Spark."""
