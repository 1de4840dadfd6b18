from . import cells, dates, ids, names, text

__all__ = ["cells", "dates", "ids", "names", "text"]
