"""chronolith: a Spark-native analytics engine for the history and source code of version-controlled projects."""

__version__ = "0.1.0"
