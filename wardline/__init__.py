"""Risk analytics over corpora of agent skill packages, as Spark plans."""
