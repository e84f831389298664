"""quirion: a PySpark-native document-analytics engine."""
