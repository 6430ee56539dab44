"""Order analytics and reorder proposals as PySpark DataFrame jobs.

Every public function takes and returns DataFrames or Columns; nothing is
collected on the driver and no Python UDF is used in the batch path.
"""
