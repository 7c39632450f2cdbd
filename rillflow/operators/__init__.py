"""DataFrame-to-DataFrame operators, the same in batch and inside ``foreachBatch``."""
