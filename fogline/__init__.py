"""fogline: belief analytics over partially observed event data, as Spark plans."""
