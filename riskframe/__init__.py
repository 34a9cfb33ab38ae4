"""riskframe: tabular risk analytics expressed as Spark DataFrame jobs.

Every public operator maps DataFrames (plus column names) to a DataFrame and
stays lazy; nothing is collected to the driver except fitted state whose
size is bounded by the schema (one row per feature), never by the data.
"""

from riskframe.session import get_session

__all__ = ["get_session"]
