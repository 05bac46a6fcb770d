"""omicsgraph: batch jobs for regulatory-graph genomics as Spark DataFrames."""
