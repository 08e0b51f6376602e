"""Fathom: a PySpark-native engine for code- and web-security data and training corpora."""
