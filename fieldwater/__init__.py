"""Metered water use and gridded environmental data on Spark DataFrames."""

from fieldwater.config import RunConfig
from fieldwater.session import build_session

__all__ = ["RunConfig", "build_session"]
