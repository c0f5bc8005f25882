"""Spark-native analytics over large catalogs of datasets.

Every public function takes and returns Spark DataFrames or Columns. Nothing
reads the clock: functions that need "now" take an explicit ``as_of``.
"""
