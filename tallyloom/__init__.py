"""tallyloom: codebook, retrieval and text-corpus analytics on Spark SQL."""
