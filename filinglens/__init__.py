"""filinglens — company-filing analytics as Spark DataFrame transforms.

Every public function takes DataFrames (or Columns) and returns DataFrames
(or Columns). Nothing is collected to the driver except size-checked query
vectors that are broadcast to the executors for similarity search.
"""

from filinglens.options import Options
from filinglens.session import ensure_checkpoint_dir, get_session

__all__ = ["Options", "ensure_checkpoint_dir", "get_session"]
