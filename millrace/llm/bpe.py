"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode."""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from functools import lru_cache
from os.path import commonprefix

import numpy as np
from pyspark.sql import DataFrame

from .common import KEPT, make_room, map_texts

#: Bounds of the memory of one compiled transducer; a table that outgrows its bound is emptied and filled anew.
MAX_STATES, MAX_PIECES, MAX_PAIRS = 300_000, 400_000, 100_000
#: Ids that the streaming decoder is fed at once.
CHUNK = 4096

_START = -1


def pack(ids: tuple[int]) -> bytes:
    return struct.pack("<I", *ids)


class Transducer:
    """Turns the bytes of one pre-token into the ids of its merges, left to right.

    Every prefix of the input has one encoding; the last token of the encoding of the prefix that ends at
    ``i`` is the one token that ends there and may stand after the last token of the prefix it starts from.
    A state holds the hypotheses still open: for each place a later token may start from, how far into a
    token the input since then has come, and the last token before that place. Each hypothesis has a register
    with the ids up to its place that are not yet written; a transition says which registers live on and which
    one gets the token that has ended. Once one hypothesis is left, its register is written; a hypothesis ends
    within the longest token's length, which bounds the lookahead. States and transitions are made when an
    input first needs them and kept.
    """

    def __init__(self, ranks: dict[bytes, int], tables: float = 1.0):
        self.ranks = ranks
        self.max_states, self.max_pairs = int(MAX_STATES * tables), int(MAX_PAIRS * tables)
        self.words = {v: k for k, v in ranks.items()}
        self.prefixes: dict[bytes, bytes] = {}  # each prefix once, so that states share it
        for token in ranks:
            for n in range(1, len(token)):
                self.prefixes.setdefault(token[:n], token[:n])
        self.packed = {t: pack((t,)) for t in self.words}
        self.kept: dict[tuple[int, ...], tuple[int, ...]] = {}
        self.reach: dict[bytes, bool] = {}
        self.splits: dict[bytes, tuple[bytes, bytes]] = {}
        self.pairs: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.open: dict[tuple[bytes, int], tuple[bytes, int]] = {}  # each hypothesis once
        self.steps: dict[int, tuple[int, int, bytes, tuple[int, ...]]] = {}  # by state and byte
        self.start = self._state(((b"", _START),))

    def _state(self, state: tuple) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
        return at

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The definition: merge the adjacent pair of lowest rank, leftmost first, down to ``least`` parts."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > least:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _reached(self, token: bytes) -> bool:
        """Whether merging the token's own bytes gives the token."""
        ok = self.reach.get(token)
        if ok is None:
            ok = self.reach[token] = self.merge(token) == [token]
        return ok

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a reached token joins."""
        got = self.splits.get(token)
        if got is None:
            got = self.splits[token] = tuple(self.merge(token, 2))
        return got

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: no merge across their border comes before it is closed.

        Undoes the merges of both, latest first. While parts x and y face each other, x is taken by the merge
        of rank ``xs`` and y by that of ``ys``; a merge of x with y of lower rank would have come first, and
        of two equal ranks the left one comes first.
        """
        ok = self.pairs.get(a << 32 | b)
        if ok is None:
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            ranks, x, y, xs, ys = self.ranks, self.words[a], self.words[b], 1 << 62, 1 << 62
            while True:
                r = ranks.get(x + y)
                if r is not None and r < xs and r <= ys:
                    ok = False
                    break
                if len(x) > 1 and (len(y) == 1 or ranks[x] > ranks[y]):
                    xs, x = ranks[x], self._split(x)[1]
                elif len(y) > 1:
                    ys, y = ranks[y], self._split(y)[0]
                else:
                    ok = True
                    break
            self.pairs[a << 32 | b] = ok
        return ok

    def _step(self, at: int, byte: bytes) -> tuple[int, int, bytes, tuple[int, ...]]:
        """Next state, the register that the ended token joins, the token, the registers that live on."""
        live, keep, src, token = [], [], -1, -1
        for k, (node, last) in enumerate(self.states[at]):
            node += byte
            if src < 0 and node in self.ranks and self._reached(node) and (last == _START or self._follows(last, self.ranks[node])):
                src, token = k, self.ranks[node]
            if node in self.prefixes:
                live.append(self._once((self.prefixes[node], last)))
                keep.append(k)
        live.append(self._once((b"", token)))
        keep = tuple(keep)
        return self._state(tuple(live)), src, self.packed[token], self.kept.setdefault(keep, keep)

    def _once(self, hypothesis: tuple[bytes, int]) -> tuple[bytes, int]:
        return self.open.setdefault(hypothesis, hypothesis)

    def encode(self, piece: bytes) -> bytes:
        """The piece's ids, four bytes each."""
        whole = self.ranks.get(piece)
        if whole is not None:  # a piece that is a token stays whole, whether or not merges reach it
            return self.packed[whole]
        if len(self.states) > self.max_states:
            self._clear()
        at, out, regs, steps = self.start, [], [b""], self.steps
        for i, byte in enumerate(piece):
            nxt = steps.get(at << 8 | byte)
            if nxt is None:
                nxt = steps[at << 8 | byte] = self._step(at, piece[i : i + 1])
            at, src, token, keep = nxt
            said = regs[src] + token
            if keep:
                regs = [regs[k] for k in keep]
                regs.append(said)
                if len(said) > 1024:
                    n = len(commonprefix(regs)) & ~3
                    out.append(said[:n])
                    regs = [r[n:] for r in regs]
            else:
                out.append(said)
                regs = [b""]
        return b"".join(out) + regs[-1]


class Encoder:
    """Whole texts to ids: splits by the pattern, each match on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, tables: float = 1.0):
        import regex

        self.fst = Transducer(ranks, tables)
        self.max_pieces = int(MAX_PIECES * tables)
        self.split = regex.compile(pattern).findall
        fst = self.fst

        class Pieces(dict):
            """Ids of pieces in two generations: a piece of the older one that is met again moves to the younger."""

            older: dict[str, bytes] = {}

            def __missing__(self, piece: str) -> bytes:
                got = self.older.pop(piece, None)
                if got is None:
                    got = fst.encode(piece.encode())
                if len(piece) <= 64:
                    self[piece] = got
                return got

            def age(self) -> None:
                self.older = dict(self)
                self.clear()

        self.pieces = Pieces()
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.words[v] = k
        self.stream = StreamDecoder(self.words)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = b"".join(map(self.pieces.__getitem__, self.split(text)))
        if len(self.pieces) > self.max_pieces // 2:
            self.pieces.age()
        return out

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 of the text that the streaming decoder makes of the ids, fed in chunks."""
        all_ids, dec = np.frombuffer(ids, dtype="<u4"), self.stream
        out = [dec.feed_bytes(all_ids[i : i + CHUNK]) for i in range(0, len(all_ids), CHUNK)]
        return b"".join([*out, dec.end().encode()])


def utf8_table() -> tuple[list[list[int]], int]:
    """Transitions of the UTF-8 automaton: by state and byte class; the last state is the error."""
    # fixed by the definition of UTF-8: lead bytes and the bounds of the byte that follows
    begin, tail1, tail2, tail3, e0, ed, f0, f4, bad = range(9)
    table = [[bad] * 256 for _ in range(9)]

    def put(state: int, lo: int, hi: int, to: int) -> None:
        table[state][lo : hi + 1] = [to] * (hi + 1 - lo)

    put(begin, 0x00, 0x7F, begin)
    put(begin, 0xC2, 0xDF, tail1)
    put(begin, 0xE0, 0xE0, e0)
    put(begin, 0xE1, 0xEC, tail2)
    put(begin, 0xED, 0xED, ed)
    put(begin, 0xEE, 0xEF, tail2)
    put(begin, 0xF0, 0xF0, f0)
    put(begin, 0xF1, 0xF3, tail3)
    put(begin, 0xF4, 0xF4, f4)
    put(tail1, 0x80, 0xBF, begin)
    put(tail2, 0x80, 0xBF, tail1)
    put(tail3, 0x80, 0xBF, tail2)
    put(e0, 0xA0, 0xBF, tail1)
    put(ed, 0x80, 0x9F, tail1)
    put(f0, 0x90, 0xBF, tail2)
    put(f4, 0x80, 0x8F, tail2)
    return table, bad


class StreamDecoder:
    """Ids to text, piece by piece: holds back the bytes of an unfinished character.

    The UTF-8 automaton's state lives across calls; a token's effect on a state is remembered. From the start state,
    runs of tokens that lead back to it are written at once. Bytes that can't be part of a character become U+FFFD
    as in Python's replacing decoder.
    """

    def __init__(self, words: list[bytes]):
        self.words, (self.table, self.bad) = words, utf8_table()
        self.state, self.held = 0, b""
        self.seen: dict[tuple[int, int], tuple[int, int]] = {}
        self.closed = np.full(len(words), -1, np.int8)  # whether a token leads from the start state back to it; -1: not yet known

    def _walk(self, state: int, token: int) -> tuple[int, int]:
        """The state after the token's bytes, and how many of its bytes are ended characters."""
        got = self.seen.get((state, token))
        if got is None:
            s, whole = state, 0
            for i, b in enumerate(self.words[token]):
                s = self.table[s][b]
                if s == 0:
                    whole = i + 1
                elif s == self.bad:
                    break
            got = self.seen[state, token] = (s, whole)
        return got

    def _one(self, token: int) -> bytes:
        state, whole = self._walk(self.state, token)
        word = self.words[token]
        if state == self.bad:
            import codecs

            d = codecs.getincrementaldecoder("utf-8")("replace")
            out = d.decode(self.held + word).encode()
            self.held, _ = d.getstate()
            self.state = 0
            for b in self.held:
                self.state = self.table[self.state][b]
            return out
        out = b""
        if whole:
            out, self.held = self.held + word[:whole], b""
        self.held += word[whole:]
        self.state = state
        return out

    def feed_bytes(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of the characters that end within these ids."""
        closed = self.closed[ids]
        if (closed < 0).any():
            for t in np.unique(ids[closed < 0]).tolist():
                self.closed[t] = self._walk(0, t)[0] == 0
            closed = self.closed[ids]
        tokens, out, i = ids.tolist(), [], 0
        for j in [*np.flatnonzero(closed == 0).tolist(), len(tokens)]:
            while i < j and self.state:
                out.append(self._one(tokens[i]))
                i += 1
            out += map(self.words.__getitem__, tokens[i:j])
            if j < len(tokens):
                out.append(self._one(tokens[j]))
            i = j + 1
        return b"".join(out)

    def feed(self, ids: list[int]) -> str:
        return self.feed_bytes(np.asarray(ids, np.int64)).decode()

    def end(self) -> str:
        out, self.held, self.state = self.held.decode("utf-8", "replace"), b"", 0
        return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str, tables: float = 1.0) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(read_ranks(f.read()), pattern, tables)


#: A compiled encoder stays for the worker's next tasks, until another operator's task needs the memory.
KEPT["bpe"] = encoder.cache_clear


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False, tables: float = 1.0, with_decoded: bool | None = None) -> DataFrame:
    """One row per document: id, ``n_tokens``; ``ids`` (little-endian u32) and ``decoded`` (UTF-8 of the text the streaming decoder makes of the ids) and their SHA-256, as asked for.

    ``path`` names a rank file that every executor has installed. ``tables`` scales the bounds of the encoder's
    tables: less memory for more time. ``with_decoded`` is as ``with_ids`` where it is not given. Null and empty texts
    give no ids. Repeated rows are encoded each on their own. Other columns are not read.
    """
    with_decoded = with_ids if with_decoded is None else with_decoded
    fields = [("n_tokens", "long")]
    fields += [("ids", "binary")] if with_ids else []
    fields += [("decoded", "binary")] if with_decoded else []
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")] if with_digests else []

    def make():
        make_room("bpe")
        enc = encoder(path, pattern, tables)

        def step(texts):
            rows = []
            gc.disable()  # its passes over the transducer's tables take longer than the work; nothing here is cyclic
            try:
                for text in texts:
                    ids = enc.encode((text or b"").decode("utf-8", "replace"))
                    back = enc.decode(ids)
                    row = (len(ids) // 4, *((ids,) if with_ids else ()), *((back,) if with_decoded else ()))
                    rows.append((*row, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) if with_digests else row)
            finally:
                gc.enable()
            return rows

        return step

    return map_texts(docs, id_col, text_col, make, fields)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id and ``text``, decoded in chunks by the incremental UTF-8 automaton."""

    def make():
        make_room("bpe")
        enc = encoder(path, pattern)

        def step(blobs):
            rows, dec = [], StreamDecoder(enc.words)
            for blob in blobs:
                ids = np.frombuffer(blob or b"", dtype="<u4")
                rows.append(("".join([*(dec.feed(ids[i : i + CHUNK].tolist()) for i in range(0, len(ids), CHUNK)), dec.end()]),))
            return rows

        return step

    return map_texts(rows, id_col, ids_col, make, [("text", "string")])


def op5(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, with_digests=True)
