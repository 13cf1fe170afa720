"""winnow: a Spark-native engine that compiles DNS filter lists and prepares text corpora."""

__version__ = "0.2.0"
