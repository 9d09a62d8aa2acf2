"""Byte-level BPE by prefix dynamic programming.

Of all tokens that end a byte prefix exactly one can be the last token of that prefix's encoding: the one that is
compatible with the stored last token of the prefix before it. So an encoder keeps one token for each prefix; the
encoding of any prefix is read by walking back, bytes are appended without looking further back than one token, and
after an edit the walk stops as soon as the stored tokens agree with the old ones for a token's length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strail.llm.common import text_of

PIECES = 500_000  # pieces that a worker remembers
HEAD, HEADS = 8, 300_000  # bytes of a prefix whose last token is remembered, and how many
LONG = 256  # longer pieces are not remembered


class Tables:
    """Ranks of a byte-level vocabulary, and how each token is made of two earlier ones."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= 1 << 20:
            raise ValueError("token ids of 2^20 and more are not supported")
        self.ranks = ranks
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.halves: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}  # when a token is made: its rank; -1 for single bytes
        self.usable: dict[bytes, int] = {}
        self.known: dict[int, bool] = {}
        self.heads: dict[bytes, int] = {}  # last tokens of prefixes of up to HEAD bytes
        self.size_of = {t: len(b) for b, t in ranks.items()}
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.made[t], self.usable[b] = -1, t
        for b, t in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) > 1:
                for cut in range(1, len(b)):
                    x, y = self.usable.get(b[:cut]), self.usable.get(b[cut:])
                    if x is not None and y is not None and self.compatible(x, y, t):
                        self.halves[t], self.made[t], self.usable[b] = (x, y), t, t
                        break
        self.known.clear()
        self.tails: dict[bytes, int] = {}  # each end of a token: the token that it is itself, or -1
        for b in ranks:
            for i in range(len(b)):
                self.tails[b[i:]] = self.usable.get(b[i:], -1)

    @classmethod
    def load(cls, path: str) -> Tables:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def compatible(self, x: int, y: int, end: int = 1 << 62) -> bool:
        """Whether merging the bytes of x and y, with merges below rank `end` only, gives just these two tokens.

        Seen backwards in time: while the tokens beside the border are x and y, no merge of the two may come before
        the next one that takes part of either. Then the later made of the two is taken apart; of equals the right one,
        as merges go from left to right.
        """
        ranks, made, text = self.ranks, self.made, self.bytes_of
        until = end  # merges across the border of a rank below this one come first
        while True:
            across = ranks.get(text[x] + text[y])
            if across is not None and across < until:
                return False
            if made[x] > made[y]:
                until, x = x, self.halves[x][1]
            elif made[y] >= 0:
                until, y = y + 1, self.halves[y][0]
            else:
                return True

    def fits(self, x: int, y: int) -> bool:
        key = x << 20 | y
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[key] = self.compatible(x, y)
        return got

    def last_token(self, data: bytes, at: int, last: list[int]) -> int:
        """The token that ends the prefix of length `at`, from those of all shorter prefixes (last[0] is -1).

        Only one token can; so the shortest is tried first, and the walk ends where no token has such an end.
        """
        tails, known, start = self.tails, self.known, at - 1
        while start >= 0:
            t = tails.get(data[start:at])
            if t is None:
                break
            if t >= 0:
                before = last[start]
                if before < 0:
                    return t
                ok = known.get(before << 20 | t)
                if ok or ok is None and self.fits(before, t):
                    return t
            start -= 1
        raise ValueError(f"no token for byte {data[at - 1]}")

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # PrefixEncoder's walk; the starts of pieces are remembered across pieces.
        heads, step, last, n = self.heads, self.last_token, [-1], len(piece)
        for at in range(1, n + 1):
            if at > HEAD:
                last.append(step(piece, at, last))
                continue
            t = heads.get(piece[:at])
            if t is None:
                if len(heads) > HEADS:
                    heads.clear()
                t = heads[piece[:at]] = step(piece, at, last)
            last.append(t)
        out, size = [], self.size_of
        while n:
            t = last[n]
            out.append(t)
            n -= size[t]
        return out[::-1]


class PrefixEncoder:
    """The encoding of all prefixes of a byte string, which may grow and change."""

    def __init__(self, tables: Tables, data: bytes = b""):
        self.tables, self.data, self.last = tables, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(len(self.data))

    def _extend(self, to: int) -> None:
        step, text, last = self.tables.last_token, self.data, self.last
        while len(last) <= to:
            last.append(step(text, len(last), last))

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the prefix of this length (default: of all)."""
        at, out, size = len(self.data) if length is None else length, [], self.tables.bytes_of
        while at:
            out.append(self.last[at])
            at -= len(size[out[-1]])
        return out[::-1]

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put data in place of the bytes [start, end); how many prefixes had to be computed anew."""
        old, rest = self.last[end + 1 :], len(self.data) - end
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start + 1 :]
        self._extend(start + len(data))
        fresh, same = len(data), 0
        for k in range(rest):
            if same >= self.tables.longest:  # no token looks further back: all that follows is as it was
                self.last += old[k:]
                break
            self._extend(len(self.last))
            fresh, same = fresh + 1, same + 1 if self.last[-1] == old[k] else 0
        return fresh


class TextEncoder(dict):
    """Maps pieces to their ids as little-endian 32-bit integers; remembers a bounded number of them."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.tables, self.find = Tables.load(path), regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = self.tables.encode_piece(piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tables.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One for each worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of each whole text (null: empty) as an array; no special tokens. A column of that name is replaced."""
    return _mapped(docs, path, pattern, text_col, [(ids_col, pa.list_(pa.int32()), "array<int>")], lambda e, t: (np.frombuffer(e.encode(t), "<i4"),))


def round_trip(docs: DataFrame, path: str, pattern: str, text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids decode to), and with ids if asked for.

    Null and empty texts have no token. Columns of these names are replaced; rows stay as many as they are.
    """

    def digest(e: TextEncoder, text: str) -> tuple:
        packed = e.encode(text)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(e.decode(packed)).hexdigest(), np.frombuffer(packed, "<i4")

    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] if keep_ids else []
    return _mapped(docs, path, pattern, text_col, fields, digest)


def _mapped(docs: DataFrame, path: str, pattern: str, text_col: str, fields: list[tuple], make) -> DataFrame:
    drop_text = len(fields) > 1
    rest = [c for c in docs.columns if c not in {f[0] for f in fields} and not (drop_text and c == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            rows = [make(e, t) for t in map(pa.StringScalar.as_py, b.column(len(rest)))]
            made = [pa.array([r[i] for r in rows], f[1]) for i, f in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], *made], names=[*rest, *(f[0] for f in fields)])

    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest] + [f"`{f[0]}` {f[2]}" for f in fields])
    return docs.select(*[F.col(f"`{c}`") for c in rest], text_of(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
