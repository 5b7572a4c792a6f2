"""byteloom: byte-level corpus analytics and recoding as Spark plans."""
