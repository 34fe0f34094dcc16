"""callscope: source-code call graphs on Spark DataFrames."""
