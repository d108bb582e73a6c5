"""SQL of the segments in degrees."""

from __future__ import annotations

from windloom.operators.geographic import DECIMALS, EAST0, NORTH0, ZONE, utm_inverse
from windloom.plans.oracle_routing import EDGES

_ENDS = {name: utm_inverse(f"CAST(x{k} + {EAST0} AS DOUBLE)", f"CAST(y{k} + {NORTH0} AS DOUBLE)", str(ZONE)) for k, name in ((1, "begin"), (2, "end"))}

SQL = {
    "segment_degrees": f"WITH {EDGES} SELECT project, feeder, node, " + ", ".join(f"round({text}, {DECIMALS}) AS {c}_{name}" for name, pair in _ENDS.items() for c, text in zip(("lon", "lat"), pair)) + " FROM edges",
}
