"""slicewatch — payment-health degradation, root cause and recovery analytics on Spark.

Every public function takes and returns DataFrames; nothing is collected to the driver.
"""

from slicewatch.params import Params

__all__ = ["Params"]
