"""answerlake: question-answering and support-desk analytics as Spark jobs."""

from answerlake.session import Tables, get_session

__all__ = ["Tables", "get_session"]
