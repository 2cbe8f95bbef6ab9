"""Study screening over run metadata, as PySpark DataFrame operators."""
