"""Sources: the driver's tables, labelled case files, and recorded event streams."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class EventParser:
    """Server-sent events from bytes in any pieces: LF, CR or CRLF, a leading byte-order mark, comments; data of one event
    joined by LF and given out at the blank line. An event over ``limit`` bytes is refused."""

    limit: int = 64 * 1024
    _rest: bytes = b""
    _started: bool = False
    _after_cr: bool = False
    _data: list[bytes] = field(default_factory=list)

    def push(self, piece: bytes) -> list[str]:
        out = []
        for i in range(len(piece)):
            ch = piece[i : i + 1]
            if ch == b"\n" and self._after_cr:
                self._after_cr = False
                continue
            self._after_cr = ch == b"\r"
            if ch not in b"\r\n":
                self._rest += ch
                if len(self._rest) + sum(map(len, self._data)) > self.limit:
                    raise ValueError("event too large")
                continue
            line, self._rest = self._rest, b""
            if not self._started:
                line, self._started = line.removeprefix(b"\xef\xbb\xbf"), True
            if not line:
                if self._data:
                    out.append(b"\n".join(self._data).decode())
                self._data = []
            elif line.startswith(b"data") and (line == b"data" or line[4:5] == b":"):
                self._data.append(line[5:].removeprefix(b" "))
        return out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, data) of recorded streams, a file each."""
    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, i, x) for p, c in zip(pdf["path"], pdf["content"]) for i, x in enumerate(EventParser().push(bytes(c) + b"\n\n"))]
            yield pd.DataFrame(rows, columns=["path", "seq", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, seq int, data string")


ROLES = ("system", "user", "assistant")
#: Fields of a chat request that are passed on.
REQUEST_FIELDS = frozenset("model messages stop stream stream_options temperature top_p max_tokens max_completion_tokens seed n presence_penalty frequency_penalty user".split())


def check_request(body: str) -> tuple[bool, str | None, str | None]:
    """(accepted, code, field) of a chat request; no value of the request appears in the answer."""
    try:
        request = json.loads(body)
    except ValueError:
        return False, "invalid_json", None
    if not isinstance(request, dict):
        return False, "invalid_request", None
    for name in sorted(set(request) - REQUEST_FIELDS):
        return False, "unsupported_field", name if name.isidentifier() else None
    messages = request.get("messages")
    if not isinstance(request.get("model"), str) or not request["model"]:
        return False, "invalid_request", "model"
    if not isinstance(messages, list) or not messages:
        return False, "invalid_request", "messages"
    for i, m in enumerate(messages):
        if not isinstance(m, dict) or set(m) != {"role", "content"} or m["role"] not in ROLES:
            return False, "invalid_request", f"messages.{i}"
        parts = m["content"] if isinstance(m["content"], list) else [{"type": "text", "text": m["content"]}]
        if not parts or not all(isinstance(p, dict) and set(p) == {"type", "text"} and p["type"] == "text" and isinstance(p["text"], str) for p in parts):
            return False, "invalid_request", f"messages.{i}.content"
    return True, None, None


def content_text(content: str | list) -> str:
    """A message's text: its text parts joined by one blank."""
    return content if isinstance(content, str) else " ".join(p["text"] for p in content)
