"""Registered queries: each job over the given tables, with its SQL twin.

The given tables hold no agent logs or commits, so ``adapters`` derives such
inputs from them; the queries then run the package's jobs on those.
"""

from . import history, money, records, report, stored, streams, traffic  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
