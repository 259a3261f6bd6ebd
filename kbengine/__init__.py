"""Knowledge-bundle analytics on Spark: corpora, retrieval, audits and releases as DataFrames."""
