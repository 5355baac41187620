"""strataform: scene-label analytics and training-data operators on PySpark DataFrames."""

__version__ = "0.1.0"
