"""Queries over Arrow Flight: statement info and statement results, as Flight SQL clients ask for them.

A request for information plans the query and answers with its schema and a
ticket that holds the query text; the ticket runs it.  Results leave in record
batches, a partition at a time.  Requests whose command is no Flight SQL
message are taken as the query text itself.  There is no authentication: bind
to an address that only trusted callers reach.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.flight as flight

from vectrove.db import Database

# Message types of Flight SQL, each with the number of the field that holds the query or its handle.
_MESSAGES = {
    "type.googleapis.com/arrow.flight.protocol.sql.CommandStatementQuery": 1,
    "type.googleapis.com/arrow.flight.protocol.sql.TicketStatementQuery": 1,
}
_TICKET = "type.googleapis.com/arrow.flight.protocol.sql.TicketStatementQuery"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(raw: bytes) -> dict[int, bytes]:
    """The length-delimited fields of a message; any other content is a ValueError."""
    found, at = {}, 0
    try:
        while at < len(raw):
            key, at = _varint(raw, at)
            size, at = _varint(raw, at)
            if key & 7 != 2 or at + size > len(raw):
                raise ValueError("no message of length-delimited fields")
            found[key >> 3], at = raw[at : at + size], at + size
    except IndexError as e:
        raise ValueError("message cut short") from e
    return found


def _field(number: int, value: bytes) -> bytes:
    size, n = bytearray(), len(value)
    while n > 127:
        size.append(n & 127 | 128)
        n >>= 7
    return bytes([number << 3 | 2, *size, n]) + value


def statement(raw: bytes) -> str:
    """The query text of a command or ticket."""
    try:
        packed = _fields(raw)
        kind = packed.get(1, b"").decode()
        if kind in _MESSAGES:
            return _fields(packed.get(2, b""))[_MESSAGES[kind]].decode()
    except (ValueError, KeyError):
        kind = ""
    if kind.startswith("type.googleapis.com/"):
        raise flight.FlightUnavailableError(f"not supported: {kind}")
    return raw.decode()


class FlightServer(flight.FlightServerBase):
    """Serves a database; ``port`` 0 takes a free one, which ``self.port`` tells."""

    def __init__(self, database: Database, host: str = "127.0.0.1", port: int = 50052, batch_rows: int = 8192):
        super().__init__(f"grpc://{host}:{port}")
        self.database, self.batch_rows = database, batch_rows

    def _schema(self, query: str) -> pa.Schema:
        try:
            return self.database.sql_df(query).limit(0).toArrow().schema
        except Exception as e:
            raise flight.FlightServerError(f"query failed: {e}") from e

    def get_flight_info(self, context, descriptor):
        query = statement(descriptor.command)
        ticket = flight.Ticket(_field(1, _TICKET.encode()) + _field(2, _field(1, query.encode())))
        return flight.FlightInfo(self._schema(query), descriptor, [flight.FlightEndpoint(ticket, [])], -1, -1)

    def get_schema(self, context, descriptor):
        return flight.SchemaResult(self._schema(statement(descriptor.command)))

    def do_get(self, context, ticket):
        query = statement(ticket.ticket)
        schema = self._schema(query)

        def batches():
            for batch in self.database.sql_stream(query, batch_rows=self.batch_rows):
                yield from pa.Table.from_batches([batch]).cast(schema).to_batches()

        return flight.GeneratorStream(schema, batches())
