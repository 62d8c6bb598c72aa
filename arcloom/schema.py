"""The archive record schema and the names of the writer's own headers.

Kept free of Spark so that tasks of the data source can import it.
"""

from __future__ import annotations

from dataclasses import dataclass

_HEADERS = "ARRAY<STRUCT<name: STRING, value: STRING>>"

RECORD_COLUMNS = {
    "file_path": "STRING", "file_seq": "BIGINT", "record_seq": "BIGINT", "record_id": "STRING",
    "rec_type": "STRING", "target_uri": "STRING", "warc_date": "TIMESTAMP", "content_type": "STRING",
    "content_length": "BIGINT", "payload_digest": "STRING", "refers_to": "STRING",
    "refers_to_uri": "STRING", "refers_to_date": "TIMESTAMP", "concurrent_to": "STRING",
    "warcinfo_id": "STRING", "truncated": "STRING", "request_id": "STRING", "sub_type": "STRING",
    "ip": "STRING", "headers": _HEADERS, "http_start_line": "STRING", "http_headers": _HEADERS,
    "payload": "BINARY",
}
RECORD_DDL = ", ".join(f"{n} {t}" for n, t in RECORD_COLUMNS.items())
INDEX_DDL = ", ".join(f"{n} {t}" for n, t in RECORD_COLUMNS.items() if n != "payload") + ", member_offset BIGINT, member_length BIGINT"
ORDER = ("file_seq", "record_seq")
SPAN_KEY = "arcloom.span"  # column metadata: order values per segment of an ordered scan
PAYLOAD_TYPES = ("resource", "response")


@dataclass(frozen=True)
class HeaderNames:
    """Names of the writer's own headers.

    ``prefix`` is what the capturing software puts before its private headers;
    give the one your archives carry.
    """

    prefix: str = "X-Capture"
    request_id: str = "X-Chrome-Request-ID"
    viewport: str = "X-Chrome-Viewport"

    @property
    def sub_type(self) -> str:
        return f"{self.prefix}-Type"

    @property
    def y_offset(self) -> str:
        return f"{self.prefix}-Screenshot-Y-Offset"


NAMES = HeaderNames()
