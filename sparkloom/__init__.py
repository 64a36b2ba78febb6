"""sparkloom: hybrid retrieval and code analytics as PySpark DataFrame operators."""
