"""DataFrame operators that Spark does not offer in the shape the analytics need."""

from parcelwise.operators.keys import KeySide, duplicate_keys, key_profile, orphan_rows, unmatched_keys
from parcelwise.operators.latest import latest_per_key
from parcelwise.operators.ntile import SortKey, distributed_ntile
from parcelwise.operators.shares import share_of_total

__all__ = [
    "SortKey",
    "KeySide",
    "distributed_ntile",
    "duplicate_keys",
    "key_profile",
    "latest_per_key",
    "orphan_rows",
    "share_of_total",
    "unmatched_keys",
]
