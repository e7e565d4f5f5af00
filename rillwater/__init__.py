"""Station-based environmental monitoring analytics, written for Spark.

Every operator takes DataFrames and parameters and returns DataFrames; column
roles are arguments (see ``rillwater.config.Roles``), nothing is global.
"""

from rillwater.config import Roles

__all__ = ["Roles"]
