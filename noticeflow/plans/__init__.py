from . import config, jobs, programs

__all__ = ["config", "jobs", "programs"]
