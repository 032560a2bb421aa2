"""quire: scholarly, graph and retrieval analytics on Spark DataFrames.

The core never imports the optional ``quire.llm`` subpackage.
"""
