"""Byte-pair encoding by a lazily determinised finite-state transducer.

For any bytes there is exactly one encoding of every prefix, and dropping its last token leaves
the encoding of the shorter prefix.  So after each byte the encoder knows *the last token* of
the prefix read so far: the one token ending here that is *compatible* with the last token of
the prefix before it (the merges, run over the two together, give back the same two).

The transducer reads byte by byte.  What it cannot know yet is which of the last positions the
final encoding passes through: those from which a longer token may still begin.  A state is
the set of these open positions with their last tokens, that is a subset of the states of the
non-deterministic transducer, built the first time it is met and looked up afterwards.  As soon
as all open positions agree on an earlier token it is emitted.  An open position is followed by
the beginning of a token, so the lookahead is bounded by the longest token of the vocabulary.

A piece (what the splitting pattern cuts out) starts in the initial state, so its ids depend on
nothing else and are kept per worker.  Emptying that store costs time, never a result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator

import numpy as np
import regex

#: The characters that the splitting pattern takes as white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Pieces, parts and states a worker keeps before it starts anew.
MAX_KEPT = 250_000
#: Parts and pieces above this many characters are encoded without being kept.
MAX_KEPT_CHARS = 40


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token -> id from a rank file: lines of a base64 token and its id."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class _State:
    __slots__ = ("lasts", "next", "rest", "tail")

    def __init__(self, tail: bytes, lasts: tuple[int, ...]) -> None:
        #: bytes since the committed position; the last token at each position from it on (-1: none)
        self.tail, self.lasts = tail, lasts
        self.next: dict[int, tuple[_State, tuple[int, ...]]] = {}
        self.rest: tuple[int, ...] | None = None


class Transducer:
    """Encodes the bytes of one piece."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.begun = {t[:n] for t in ranks for n in range(1, len(t))}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(b"", (-1,))
        self.pairs.clear()

    def merged(self, data: bytes) -> list[int]:
        """The merges as they are defined, on short bytes: join the pair of least rank, the first
        of equal ones, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _compatible(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?  ``left`` = -1: at the start of a piece."""
        if left < 0:
            if right not in self.alone:
                self.alone[right] = self.merged(self.token[right]) == [right]
            return self.alone[right]
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def _state(self, tail: bytes, lasts: tuple[int, ...]) -> _State:
        key = (tail, lasts)
        if key not in self.states:
            self.states[key] = _State(tail, lasts)
        return self.states[key]

    def _step(self, s: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The successor of a state and what is emitted on the way."""
        tail = s.tail + bytes((byte,))
        n = len(tail)
        last = -1
        for at in range(n):
            t = self.ranks.get(tail[at:])
            # a position without last token is closed, but for the start of the piece
            if t is not None and (s.lasts[at] >= 0 or (at == 0 and s.lasts[0] == -1)) and self._compatible(s.lasts[at], t):
                last = t
                break
        lasts = [*s.lasts, last]
        still = [p for p in range(n) if (lasts[p] >= 0 or p == 0) and tail[p:] in self.begun]
        open_ = [*still, n]
        chains = []
        for p in open_:
            chain = [p]
            while chain[-1] > 0:
                chain.append(chain[-1] - len(self.token[lasts[chain[-1]]]))
            chains.append(chain)
        shared = set(chains[0]).intersection(*chains[1:])
        commit = max(shared)
        emitted, at = [], commit
        while at > 0:
            emitted.append(lasts[at])
            at -= len(self.token[lasts[at]])
        needed = {p for chain in chains for p in chain}
        kept = tuple(lasts[p] if p in needed else -2 for p in range(commit, n + 1))
        return self._state(tail[commit:], kept), tuple(reversed(emitted))

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > MAX_KEPT:
            self.reset()
        out: list[int] = []
        s = self.start
        for byte in data:
            hit = s.next.get(byte)
            if hit is None:
                hit = s.next[byte] = self._step(s, byte)
            s, emitted = hit
            if emitted:
                out.extend(emitted)
        if s.rest is None:
            rest, at = [], len(s.tail)
            while at > 0:
                rest.append(s.lasts[at])
                at -= len(self.token[s.lasts[at]])
            s.rest = tuple(reversed(rest))
        out.extend(s.rest)
        return out


class _Uneven(Exception):
    """A space has white space beside it."""


class Encoder(dict):
    """Text -> ids as the bytes of 32-bit integers.

    No piece crosses from text into following white space, so a text may be cut before any
    space that has text on both sides; as a dict this object keeps the ids of such parts, each
    with the space before it.  Runs of white space are cut out first.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.fst = Transducer(ranks)
        self.pieces: dict[str, bytes] = {}
        self.split = regex.compile(pattern).findall
        self.runs = re.compile(f"[{SPACE}]{{2,}}|[{SPACE}]\\Z").finditer

    def __missing__(self, part: str) -> bytes:
        if not part or part[0] in SPACE or part[-1] in SPACE:
            raise _Uneven
        ids = b"".join(map(self._piece, self.split(" " + part)))
        if len(part) <= MAX_KEPT_CHARS:
            if len(self) > MAX_KEPT:
                self.clear()
            self[part] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array(self.fst.encode(piece.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes()
            if len(piece) <= MAX_KEPT_CHARS:
                if len(self.pieces) > MAX_KEPT:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        try:
            return b"".join(self._even("", text))
        except _Uneven:
            return b"".join(self._cut_at_runs(text))

    def _even(self, before: str, text: str) -> list[bytes]:
        """Ids of a text without runs of white space, ``before`` being the space it follows."""
        first, *parts = text.split(" ")
        if before == " ":
            return [*map(self.__getitem__, (first, *parts))]
        if parts and first and first[-1] in SPACE:
            raise _Uneven
        return [*map(self._piece, self.split(before + first)), *map(self.__getitem__, parts)]

    def _cut_at_runs(self, text: str) -> Iterator[bytes]:
        """A run of white space is a piece, but its last one belongs to what follows it."""
        before, at = "", 0
        for run in self.runs(text):
            a, b = run.span()
            if at < a:
                yield from self._even(before, text[at:a])
            elif before:
                yield self._piece(before)
            if b == len(text):
                yield self._piece(text[a:b])
                return
            yield self._piece(text[a : b - 1])
            before, at = text[b - 1], b
        yield from self._even(before, text[at:])

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """The worker's encoder of a rank file; it stays while the worker does."""
    key = (len(raw), hash(raw), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(raw), pattern)
    return _ENCODERS[key]


class Utf8:
    """Incremental UTF-8 state machine: bytes in any cuts, whole characters out.

    The state is how many continuation bytes are missing and in which range the next must be;
    a byte that does not fit ends the character as U+FFFD and is read again as a first byte.
    """

    def __init__(self) -> None:
        self.missing, self.low, self.high = 0, 0x80, 0xBF
        self.held = bytearray()

    @staticmethod
    def _lead(b: int) -> tuple[int, int, int] | None:
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return None

    def feed(self, data: bytes) -> str:
        if not self.missing:
            try:
                return data.decode("utf-8")  # the common case: whole characters
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for b in data:
            if self.missing and not self.low <= b <= self.high:
                out.append("\ufffd")
                self.missing = 0
            if self.missing:
                self.held.append(b)
                self.missing, self.low, self.high = self.missing - 1, 0x80, 0xBF
                if not self.missing:
                    out.append(self.held.decode("utf-8"))
            elif b < 0x80:
                out.append(chr(b))
            elif (lead := self._lead(b)) is not None:
                self.missing, self.low, self.high = lead
                self.held = bytearray((b,))
            else:
                out.append("\ufffd")
        return "".join(out)

    def end(self) -> str:
        cut, self.missing = self.missing > 0, 0
        return "\ufffd" if cut else ""


def decode(ids: Iterable[int], token: dict[int, bytes], block: int = 4096) -> Iterator[str]:
    """Text of ids, block by block; an unknown id gives U+FFFD."""
    machine, waiting = Utf8(), []
    for i in ids:
        waiting.append(token.get(i, b"\xff"))
        if len(waiting) >= block:
            yield machine.feed(b"".join(waiting))
            waiting.clear()
    yield machine.feed(b"".join(waiting)) + machine.end()
