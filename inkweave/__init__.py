"""Document-corpus analytics on Apache Spark: lexical, semantic and graph operators over DataFrames."""

__version__ = "0.1.0"
