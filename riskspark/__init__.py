"""riskspark: credit-default analytics as PySpark DataFrame operators."""
