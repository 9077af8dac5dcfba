"""Sources and sinks: schemas, readers, the stand-in adapter, CSV export, snapshots."""
