from . import daily_csv, envelope, landed, paged_rest, store

__all__ = ["daily_csv", "envelope", "landed", "paged_rest", "store"]
