"""Reading and writing keyed structures: dumps, snapshots and change logs."""
