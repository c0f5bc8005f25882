"""What the tests of the catalog share."""

from datetime import datetime

NOW = datetime(2024, 3, 1, 12, 0, 0)


def table(spark, schema, rows):
    """Rows given as dicts; missing columns are NULL."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
