from lossledger.operators.keys import sequential_key
from lossledger.operators.latest import latest_per_key
from lossledger.operators.upsert import upsert

__all__ = ["sequential_key", "latest_per_key", "upsert"]
