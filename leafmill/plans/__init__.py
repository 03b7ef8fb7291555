"""Registered queries: importing the package fills the registry."""

from leafmill.plans import families, formats, relational, scalars, streams, udfs  # noqa: F401
