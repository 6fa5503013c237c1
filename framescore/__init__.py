"""framescore: feature-record encoding, streaming scoring and evaluation on Spark.

Every public operator is a function ``DataFrame -> DataFrame`` (or a column
expression) that works on bounded and unbounded input alike.
"""

from framescore.session import get_session, materialize, shared_path

__all__ = ["get_session", "materialize", "shared_path"]
