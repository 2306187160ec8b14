"""PySpark-native engine for curating speech-recognition training corpora."""
