"""terraquarry: a PySpark-native engine for tiled, multi-temporal raster collections.

Every public operator takes DataFrames and returns a DataFrame. Nothing in this
package collects data to the driver unless its size is bounded and documented.
"""

__version__ = "0.1.0"
