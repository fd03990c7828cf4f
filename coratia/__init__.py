"""Review, basket, similarity, rating and graph analytics on Spark DataFrames."""

from coratia.session import build_session

__all__ = ["build_session"]
