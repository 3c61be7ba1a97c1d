"""tessera: a PySpark-native engine for supervised fine-tuning data."""

__version__ = "0.1.0"
