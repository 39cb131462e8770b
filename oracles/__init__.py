"""The catalog's queries again, as SQL for an independent engine."""
