"""indicata: community indicator tables (survey estimates, register summaries,
series and area crosswalks) computed as Spark DataFrame jobs."""

from indicata.session import get_session

__all__ = ["get_session"]
