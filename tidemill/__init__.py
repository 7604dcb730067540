"""A toolkit for everyday data engineering, written as ordinary Spark jobs.

Every operator is a function from DataFrame to DataFrame.  Nothing here parses
queries, plans them or stores data: Catalyst, Tungsten and the file sources do.
"""

from tidemill.session import build_session

__all__ = ["build_session"]
