"""Row-wise operators that accept a streaming DataFrame as it is.

They run no action and keep no state, so they need no watermark. The operators that must look at the
whole table first (null policy, date buckets, entropy, indexes) are for finite tables; fitted once,
their models can be applied to a stream.
"""

from colscope.functions.arrays import array_first_term, array_indicators
from colscope.functions.dates import apply_date_buckets, date_span
from colscope.functions.typing import cast_by_role, date_to_long

__all__ = [
    "apply_date_buckets",
    "array_first_term",
    "array_indicators",
    "cast_by_role",
    "date_span",
    "date_to_long",
]
