"""Sparse environmental sensor analytics on Spark DataFrames.

Every public operator takes DataFrames and returns DataFrames. Operators are
lazy except where a step read many times is checkpointed (``exact_quantiles``,
``number_rows``, model training) and where the name says so (``publish``,
``export``, ``write``, ``train``).
"""

from wellspring.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
