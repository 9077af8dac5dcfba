"""Generic operators: table view, validation, batch changes, integrity checks."""
