"""Record linkage, text mining, graph and ranking-evaluation operators over Spark DataFrames."""
