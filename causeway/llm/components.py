"""Connected components, from the core."""

from causeway.operators.components import connected_components  # noqa: F401
