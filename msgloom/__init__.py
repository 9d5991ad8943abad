"""Message-corpus analytics on Spark."""
