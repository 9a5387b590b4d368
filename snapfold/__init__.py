"""snapfold: fold successive exports of sales opportunities into tracking tables with Spark."""

from snapfold.config import Config

__all__ = ["Config"]
