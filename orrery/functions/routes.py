"""Routes: a marker on the symbol wins over a recorded concept; transports aren't methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a transport.
TRANSPORTS = {"WS": "websocket", "LIVE": "liveview", "RPC": "grpc"}


def _pick(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def route_of(meta: Column, concept: Column) -> Column:
    """struct(path, method, protocol), or null without marker and concept. ``meta`` and ``concept`` are structs, either may be null."""
    marked = F.coalesce(meta["framework_role"] == "route", F.lit(False))
    path = F.when(marked, meta["route_path"]).otherwise(concept["path"])
    raw = F.when(marked, meta["http_method"]).otherwise(concept["method"])
    protocol = F.coalesce(meta["route_protocol"], _pick(raw, TRANSPORTS), F.lit("http"))
    method = F.when(~protocol.isin(*TRANSPORTS.values()), raw)
    return F.when(marked | concept.isNotNull(), F.struct(path.alias("path"), method.alias("method"), protocol.alias("protocol")))


def method_token(protocol: Column, method: Column) -> Column:
    """The transport's token, or the method."""
    return F.coalesce(_pick(protocol, {v: k for k, v in TRANSPORTS.items()}), method)
