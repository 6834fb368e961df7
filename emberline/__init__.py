"""emberline: wildfire-risk tables and streams on Apache Spark.

Every public function takes and returns DataFrames (or Columns) and is lazy;
actions happen only in sinks, model fitting and streaming queries.
"""

from emberline.spec import AlertSpec, RegionSpec, SpreadSpec

__all__ = ["AlertSpec", "RegionSpec", "SpreadSpec"]
