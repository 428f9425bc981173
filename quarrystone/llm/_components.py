"""Connected components, as the corpus operators use them."""

from quarrystone.operators.components import components

__all__ = ["components"]
