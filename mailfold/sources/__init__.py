"""Reading and writing message archives, sheets and snapshots."""
