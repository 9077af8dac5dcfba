"""carelake: clinic-records analytics as Spark DataFrame jobs.

Sub-packages:
  sources    - fixed schemas, table scans, stand-in adapter, CSV export and snapshot sink
  functions  - scalar column expressions (display text, money, ENUM ordinals)
  plans      - the named reports (one DataFrame job each)
  operators  - generic table view, validation, batch changes, integrity checks
"""

from .sources.tables import Tables, load_tables  # noqa: F401
