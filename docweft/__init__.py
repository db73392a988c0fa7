"""docweft: a Spark-native document intelligence engine.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
transformations, ``sources`` readers and writers, ``plans`` whole queries composed
of operators and ``streaming`` the Structured Streaming jobs.  ``llm`` holds the
operators for training-data pipelines; nothing outside it imports it.
"""

__version__ = "0.1.0"
