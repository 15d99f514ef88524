"""All registered queries of the engine's own operators."""

from quillstone.queries import filters, lifecycle, relations, storage

ALL = {**filters.QUERIES, **relations.QUERIES, **lifecycle.QUERIES, **storage.QUERIES}
