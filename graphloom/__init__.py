"""graphloom: a Spark-native engine for knowledge-graph building and retrieval.

Everything relational is an ordinary DataFrame plan; Python is used only where
an operator cannot be expressed with built-in functions (model hooks, iterative
clustering, tokenizers), and then in Arrow batches on the executors.
"""

__version__ = "0.1.0"
