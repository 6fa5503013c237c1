"""L1: first N records in input order.

``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: every task keeps
its own top n and only n rows per task reach the final merge; there is no
global sort.  A plain ``limit`` is not order-safe and is not used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_n(df: DataFrame, n: int, order_by) -> DataFrame:
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]).limit(int(n))
