"""Column-expression building blocks (all built-in Spark functions)."""

from winnow.functions.text import (  # noqa: F401
    WS29, blank_to_empty, is_blank, last_number, py_strip, tokenize_alnum,
    tokenize_whitespace,
)
from winnow.functions.hashing import draw_key  # noqa: F401
from winnow.functions.vector import cosine, dot, l2_normalize, norm  # noqa: F401
