"""PySpark-native engine for finding, masking and auditing personal information in text tables."""

__version__ = "0.1.0"
