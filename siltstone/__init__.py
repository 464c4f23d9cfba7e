"""Site-corpus analytics and training-data preparation on PySpark."""
