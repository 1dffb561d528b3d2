"""Tokens restored in a stream of chunks, however the chunks cut them.

What may be the beginning of a token is held back, at most ``MAX_TOKEN_LENGTH`` characters; the
rest goes out at once.  The same object serves batches (chunks of a stream in order) and
Structured Streaming (state per stream).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismveil.functions.categories import ESCAPED_CLOSE, ESCAPED_OPEN, MAX_TOKEN_LENGTH
from prismveil.operators.tokenisation import restorer

_OPEN, _CLOSE = f"[{ESCAPED_OPEN}", f"]{ESCAPED_CLOSE}"


def _first(text: str, chars: str) -> int:
    at = [i for i in map(text.find, chars) if i >= 0]
    return min(at) if at else -1


class StreamDesanitizer:
    """``feed`` returns what is certain, ``flush`` the rest."""

    def __init__(self, tokens: dict[str, str], held: str = "", max_chars: int = 0, seen: int = 0) -> None:
        self.values = {t.lower(): v for t, v in tokens.items()}
        self.held, self.max_chars, self.seen = held, max_chars, seen
        self._unescape = restorer({})

    def feed(self, chunk: str | None) -> str:
        chunk = chunk or ""
        self.seen += len(chunk)
        if self.max_chars and self.seen > self.max_chars:
            raise ValueError(f"stream of {self.seen} characters exceeds {self.max_chars}")
        text, out = self.held + chunk, []
        while text:
            start = _first(text, _OPEN)
            if start < 0:
                out.append(text)
                text = ""
                break
            out.append(text[:start])
            text = text[start:]
            end = _first(text, _CLOSE)
            if end >= 0:
                token = text[: end + 1]
                out.append(self.values.get(token.lower(), token))
                text = text[end + 1 :]
            elif len(text) > MAX_TOKEN_LENGTH:
                out.append(text[0])
                text = text[1:]
            else:
                break
        self.held = text
        return self._unescape("".join(out))

    def flush(self) -> str:
        rest, self.held = self.held, ""
        return self._unescape(rest)


def desanitize_chunks(chunks: DataFrame, tokens: DataFrame, stream: str = "stream_id", seq: str = "seq", delta: str = "delta") -> DataFrame:
    """``stream, seq, text``: what each chunk gives, the last one with the rest of its stream.

    ``tokens`` has ``stream, token, value``.  Chunks are sorted inside their partition and
    folded as they come, so a stream of any length holds one buffer.  Null chunks are empty;
    streams without tokens pass through.
    """
    maps = tokens.groupBy(stream).agg(F.map_from_entries(F.collect_set(F.struct("token", "value"))).alias("_map"))
    last = chunks.groupBy(stream).agg(F.max(seq).alias("_last"))
    ends = last.join(maps, stream, "left")
    schema = T.StructType([chunks.schema[stream], chunks.schema[seq], T.StructField("text", T.StringType())])
    rows = chunks.select(stream, seq, delta)
    # the map of a stream goes with its first chunk only
    first = chunks.groupBy(stream).agg(F.min(seq).alias(seq))
    carried = first.join(ends, stream).select(stream, seq, "_map", "_last")
    joined = rows.join(carried, [stream, seq], "left").select(stream, seq, delta, "_map", "_last")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, machine, end = object(), StreamDesanitizer({}), None
        for b in batches:
            out = []
            for s, q, d, m, e in zip(b[stream], b[seq], b[delta], b["_map"], b["_last"]):
                if s != current:
                    current, machine, end = s, StreamDesanitizer(dict(m or ())), e
                text = machine.feed(d)
                out.append((s, q, text + machine.flush() if q == end else text))
            yield pd.DataFrame(out, columns=schema.names)

    return joined.repartition(stream).sortWithinPartitions(stream, seq).mapInPandas(fold, schema)


def desanitize_stream(chunks: DataFrame, tokens: dict[str, dict[str, str]] | None = None, max_chars: int = 0) -> DataFrame:
    """Structured Streaming: ``stream_id, seq, text`` from ``stream_id, seq, delta, is_end,
    tokens`` (the map comes with any chunk of its stream, or in ``tokens`` by stream).

    Chunks may arrive out of order and in any micro-batch: one that is ahead waits in the state
    for those before it.  A stream's state is its buffer, map and waiting chunks; it is dropped
    with the chunk that ends it.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    known = tokens or {}

    class Restore(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "next bigint, held string, seen bigint")
            self.map = handle.getMapState("map", "token string", "value string")
            self.waiting = handle.getMapState("waiting", "seq bigint", "delta string, is_end boolean")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
            for frame in rows:
                for seq, delta, end, m in zip(frame["seq"], frame["delta"], frame["is_end"], frame["tokens"]):
                    for t, v in dict(m if m is not None else ()).items():
                        self.map.updateValue((t,), (v,))
                    self.waiting.updateValue((int(seq),), (delta, bool(end)))
            nxt, held, seen = self.state.get() if self.state.exists() else (0, "", 0)
            values = {t[0]: v[0] for t, v in self.map.iterator()} | known.get(key[0], {})
            machine, out, ended = StreamDesanitizer(values, held, max_chars, seen), [], False
            while not ended and self.waiting.containsKey((nxt,)):
                delta, ended = self.waiting.getValue((nxt,))
                self.waiting.removeKey((nxt,))
                text = machine.feed(delta)
                out.append((key[0], nxt, text + machine.flush() if ended else text))
                nxt += 1
            if ended:
                self.state.clear()
                self.map.clear()
                self.waiting.clear()
            else:
                self.state.update((nxt, machine.held, machine.seen))
            yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

        def close(self) -> None:
            pass

    return chunks.groupBy("stream_id").transformWithStateInPandas(Restore(), "stream_id string, seq bigint, text string", "append", "none")
