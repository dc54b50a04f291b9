"""quillspark: text, graph and usage analytics on Spark DataFrames."""
