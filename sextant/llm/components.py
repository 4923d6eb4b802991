"""Connected components, as the rest of the library has them."""

from sextant.operators.graph import components

__all__ = ["components"]
