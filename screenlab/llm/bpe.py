"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 machine.

Encoding rests on two facts about rank-ordered merging of one pre-token. A token sequence is the
encoding of its bytes exactly if each neighbouring pair is the encoding of the pair's bytes; and every
prefix of a pre-token has one encoding, so one last token. The transducer reads bytes from left to
right and keeps, for the bytes not yet emitted, the last token at each position. A later token can start
only where the bytes since then begin some vocabulary entry. Once the paths back from all those places
meet, what lies before the meeting point cannot change any more and is emitted; the lookahead is at most
the longest vocabulary entry. A state is what is pending; the token emitted last is a register beside it,
asked only whether a token may start right behind it. So texts share states whatever came before. States
and transitions are made when first met and kept up to a bound.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import Memo, parts, split_tail, windows
from .store import kept


def read_ranks(lines) -> dict[bytes, int]:
    """Ranks from lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


#: A rank beyond all others.
_NEVER = 1 << 62


class _State:
    """What is pending after the last emitted token.

    ``back[j]`` is (start, token) of the last token of the prefix that ends after ``j + 1`` pending bytes;
    ``live`` are (start, token before, vocabulary entries by next byte) of places where a token may still
    grow, the token before the first place being the register. ``steps`` has for each byte the token that
    would reach from the first place to here, and where to go if it may, and if not.
    """

    __slots__ = ("back", "live", "steps", "tail")

    def __init__(self, back: tuple, live: tuple):
        self.back, self.live = back, live
        self.steps: dict[int, list] = {}
        self.tail: tuple[int, ...] | None = None


class Transducer:
    """Encodes pre-tokens with ``ranks`` (token bytes to rank; all 256 bytes present)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 180_000, max_pairs: int = 400_000):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.bytes_of = {r: b for b, r in ranks.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._events: dict[int, list[tuple]] = {}
        self._states: dict[tuple, _State] = {}
        # by first byte: (token or None, entries by next byte or None); tokens that merging cannot reach are left out
        grow: dict = {}
        for token, rank in ranks.items():
            if len(token) == 1 or self._merged(token) == [rank]:
                at = grow
                for byte in token[:-1]:
                    at = at.setdefault(byte, [None, {}])[1]
                at.setdefault(token[-1], [None, {}])[0] = rank
        self._root = self._closed(grow)
        self._start = self._fresh()

    def _closed(self, grow: dict) -> dict:
        return {byte: (token, self._closed(below) if below else None) for byte, (token, below) in grow.items()}

    def _fresh(self) -> _State:
        for state in self._states.values():
            state.steps.clear()  # they point at each other
        self._states.clear()
        return self._states.setdefault((), _State((), ((0, -1, self._root),)))

    def _merged(self, piece: bytes, events: list | None = None) -> list[int]:
        """Plain merging by lowest rank, leftmost first; for compiling only.

        ``events`` gets (rank, first part, last part) of each merge, parts as they are before it.
        """
        ends, ranks = list(range(len(piece) + 1)), self.ranks
        while len(ends) > 2:
            best, at = None, 0
            for i in range(len(ends) - 2):
                r = ranks.get(piece[ends[i] : ends[i + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if events is not None:
                events.append((best, piece[: ends[1]], piece[ends[-2] :]))
            del ends[at + 1]
        return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:])]

    def _merges(self, token: int) -> list[tuple]:
        """The merges that make a token, and an end that never comes."""
        if token not in self._events:
            made, piece = [], self.bytes_of[token]
            self._merged(piece, made)
            self._events[token] = [*made, (_NEVER, piece, piece)]
        return self._events[token]

    def _agree(self, left: int, right: int) -> bool:
        """Whether the two tokens stand as they are when next to each other.

        Both sides merge as they would alone, the lower rank first, the left side on a tie, until the
        parts that touch have a merge of their own that comes before the next of either side.
        """
        known = left < 0 or self._pairs.get((left, right))
        if known is None:
            ranks, a, b, i, j = self.ranks, self._merges(left), self._merges(right), 0, 0
            while True:
                (next_a, _, last), (next_b, first, _) = a[i], b[j]
                across = ranks.get(last + first, _NEVER)
                if across < next_a and across <= next_b:
                    known = False
                    break
                if next_a == next_b == _NEVER:
                    known = True
                    break
                if next_a <= next_b:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= self.max_pairs:
                self._pairs.clear()
            self._pairs[left, right] = known
        return known

    def _first(self, state: _State, byte: int) -> list:
        """The token from the first place that ``byte`` completes, and room for where to go."""
        start, _, node = state.live[0]
        below = node.get(byte) if not start else None
        return [below[0] if below is not None else None, None, None]

    def _step(self, state: _State, byte: int, first: int | None) -> tuple[tuple[int, ...], _State]:
        """Emitted tokens and next state; ``first`` is the token from the first place if it may stand there."""
        back, size = state.back, len(state.back) + 1
        live, last = [], None if first is None else (0, first)
        for start, before, node in state.live:
            below = node.get(byte)
            if below is not None:
                token, more = below
                if start and last is None and token is not None and self._agree(before, token):
                    last = (start, token)
                if more is not None:
                    live.append((start, before, more))
        if last is None:
            raise ValueError("the ranks lack a single byte")
        back = (*back, last)
        # the last place that the paths back from all live places share
        shared = size
        for start, _, _ in live:
            while shared != start:
                if shared > start:
                    shared = back[shared - 1][0]
                else:
                    start = back[start - 1][0]
            if not shared:
                break
        live.append((size, last[1], self._root))
        out = self._path(back, shared)
        if shared:
            back = tuple([(start - shared if start > shared else 0, token) for start, token in back[shared:]])
            live = [(start - shared, before if start > shared else -1, node) for start, before, node in live]
        there = self._states.get(back)  # tells all: the bytes pending, and so the live places
        if there is None:
            there = self._states[back] = _State(back, tuple(live))
        return out, there

    @staticmethod
    def _path(back: tuple, end: int) -> tuple[int, ...]:
        out = []
        while end:
            end, token = back[end - 1]
            out.append(token)
        return tuple(out[::-1])

    def stream(self, piece: bytes) -> Iterator[tuple[int, ...]]:
        """Tokens of one pre-token, each as soon as no later byte can change it."""
        state, prev, pairs = self._start, -1, self._pairs
        for byte in piece:
            found = state.steps.get(byte)
            if found is None:
                found = state.steps[byte] = self._first(state, byte)
            first = found[0]
            may = 2
            if first is not None:
                known = prev < 0 or pairs.get((prev, first))
                may = 1 if (self._agree(prev, first) if known is None else known) else 2
            out, state = found[may] or self._fill(state, byte, found, may)
            if out:
                prev = out[-1]
                yield out
        if state.tail is None:
            state.tail = self._path(state.back, len(state.back))
        yield state.tail
        if len(self._states) > self.max_states:
            self._start = self._fresh()

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Tokens of one pre-token; a pre-token that is itself an entry is that entry. The loop is that of ``stream``."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        state, prev, pairs, made = self._start, -1, self._pairs, ()
        for byte in piece:
            found = state.steps.get(byte)
            if found is None:
                found = state.steps[byte] = self._first(state, byte)
            first = found[0]
            if first is None:
                step = found[2] or self._fill(state, byte, found, 2)
            else:
                known = prev < 0 or pairs.get((prev, first))
                if known is None:
                    known = self._agree(prev, first)
                step = found[2 - known] or self._fill(state, byte, found, 2 - known)
            out, state = step
            if out:
                prev = out[-1]
                made += out
        if state.tail is None:
            state.tail = self._path(state.back, len(state.back))
        made += state.tail
        if len(self._states) > self.max_states:
            self._start = self._fresh()
        return made

    def _fill(self, state: _State, byte: int, found: list, may: int) -> tuple:
        found[may] = self._step(state, byte, found[0] if may == 1 else None)
        return found[may]


#: Byte classes of UTF-8 (RFC 3629) as (first, last, class), and for each state the classes
#: that lead on. State 0 is between characters; a class missing from a state is an error.
UTF8_CLASSES = (
    (0x00, 0x7F, 0), (0x80, 0x8F, 1), (0x90, 0x9F, 2), (0xA0, 0xBF, 3), (0xC2, 0xDF, 4), (0xE0, 0xE0, 5),
    (0xE1, 0xEC, 6), (0xED, 0xED, 7), (0xEE, 0xEF, 6), (0xF0, 0xF0, 8), (0xF1, 0xF3, 9), (0xF4, 0xF4, 10),
)
UTF8_STATES = (
    {0: 0, 4: 1, 5: 2, 6: 3, 7: 4, 8: 5, 9: 6, 10: 7},
    {1: 0, 2: 0, 3: 0},
    {3: 1},
    {1: 1, 2: 1, 3: 1},
    {1: 1, 2: 1},
    {2: 3, 3: 3},
    {1: 3, 2: 3, 3: 3},
    {1: 3},
)


def _utf8_table() -> list[list[int]]:
    of = [-1] * 256
    for first, last, kind in UTF8_CLASSES:
        of[first : last + 1] = [kind] * (last + 1 - first)
    return [[row.get(kind, -1) for kind in of] for row in UTF8_STATES]


class StreamDecoder:
    """Token ids to text, given out as soon as characters are whole; wrong bytes become U+FFFD."""

    TABLE = _utf8_table()

    def __init__(self, bytes_of: dict[int, bytes], open_ids: frozenset[int]):
        self.bytes_of, self.open_ids, self.state, self.rest = bytes_of, open_ids, 0, b""

    @classmethod
    def open_tokens(cls, bytes_of: dict[int, bytes]) -> frozenset[int]:
        """Tokens that do not take the machine from state 0 back to state 0."""
        return frozenset(i for i, b in bytes_of.items() if cls.run(0, b)[0])

    @classmethod
    def run(cls, state: int, data: bytes) -> tuple[int, int]:
        """State after ``data``, and how much of it ends with the last whole character; -1 on a wrong byte."""
        whole = 0
        for i, byte in enumerate(data):
            state = cls.TABLE[state][byte]
            if state < 0:
                return state, whole
            if not state:
                whole = i + 1
        return state, whole

    def feed(self, ids: list[int]) -> str:
        """Text of the characters that ``ids`` complete."""
        data = b"".join(map(self.bytes_of.__getitem__, ids))
        if not self.state and self.open_ids.isdisjoint(ids):
            return data.decode()
        data = self.rest + data
        self.state, whole = self.run(0, data)
        if self.state < 0:  # not UTF-8: keep what may still be the start of a character
            whole = len(data) - next((k for k in (3, 2, 1) if len(data) >= k and self.run(0, data[-k:])[0] > 0), 0)
            self.state = self.run(0, data[whole:])[0]
        self.rest = data[whole:]
        return data[:whole].decode(errors="replace")

    def close(self) -> str:
        """What is left of an unfinished character."""
        rest, self.rest, self.state = self.rest, b"", 0
        return rest.decode(errors="replace")


def public_pattern() -> str:
    """The pattern for which ``chunks`` knows safe cuts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Whole texts to ids and back: cuts into pre-tokens, encodes by transducer, remembers common words.

    The cuts of ``chunks`` hold for the public pattern of letters, numbers, other marks and white space;
    with any other pattern texts are taken whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, words_kept: int = 500_000, max_states: int = 180_000):
        self.transducer = Transducer(ranks, max_states)
        self.bytes_of = self.transducer.bytes_of
        self.open_ids = StreamDecoder.open_tokens(self.bytes_of)
        self.digits = {i: str(i) for i in self.bytes_of}
        self._tails = Memo(lambda tail: self.transducer.encode(tail.encode()), 10_000)
        self._find, self._words = regex.compile(pattern).findall, Memo(self._word, words_kept)
        self.cuts = pattern == public_pattern()

    def _word(self, part: str) -> tuple[int, ...]:
        """Tokens of a part after a space."""
        stem, tail = split_tail(part)
        if tail:
            return self._words[stem] + self._tails[tail]
        if part.isalpha():  # one pre-token
            return self.transducer.encode(b" " + part.encode())
        return self._plain(" " + part)

    def _plain(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(self.transducer.encode(piece.encode()) for piece in self._find(text)))

    def encode(self, text: str) -> list[int]:
        if not self.cuts:
            return list(self._plain(text))
        head, *rest = parts(text)
        return [*self._plain(head), *chain.from_iterable(map(self._words.__getitem__, rest))]

    def decode(self, ids: list[int], block: int = 4_096) -> Iterator[str]:
        decoder = StreamDecoder(self.bytes_of, self.open_ids)
        for i in range(0, len(ids), block):
            yield decoder.feed(ids[i : i + block])
        yield decoder.close()


_CODECS: dict[tuple, Codec] = {}


def codec(ranks_file: str, pattern: str, words_kept: int = 500_000, max_states: int = 180_000) -> Codec:
    """The worker's codec for a rank file; made once in each Python worker."""
    key = (ranks_file, pattern, words_kept, max_states)
    if key not in _CODECS:
        with open(ranks_file, "rb") as f:
            _CODECS[key] = Codec(read_ranks(f), pattern, words_kept, max_states)
        # the compiled tables stay for the worker's life: the collector need not walk them, nor run after each few objects
        gc.freeze()
        gc.set_threshold(1_000_000, 50, 1000)
    return _CODECS[key]


FIELDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "token_ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
    "decoded": (T.StringType(), pa.string()),
}


def encode_texts(docs: DataFrame, ranks_file: Callable[[], str], pattern: str, keep: list[str], out: list[str], text: str = "text", step: int = 1 << 20, words_kept: int = 500_000, max_states: int = 180_000) -> DataFrame:
    """Encode and decode each text; returns the columns ``keep`` and the fields ``out`` of ``FIELDS``.

    ``ranks_file`` is called on the executor and gives the rank file's path there. Null text counts as
    empty: no tokens. Special strings are plain text. Rows stay independent: repeated rows give repeated
    results, an empty table an empty one. Texts are encoded in windows of about ``step`` characters.
    A worker remembers ``words_kept`` words and ``max_states`` states: about 500 MB as they stand, 330 MB
    at 300,000 and 60,000. Less is slower, never different.
    """
    source = docs.select(*[docs[c] for c in kept(keep, out)], docs[text].alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(k, FIELDS[k][0]) for k in out)])

    def rows(batches):
        codes = codec(ranks_file(), pattern, words_kept, max_states)
        for batch in batches:
            size = max(1, min(batch.num_rows, (batch.num_rows << 21) // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                made: dict[str, list] = {k: [] for k in out}
                for value in part.column(part.num_columns - 1):
                    ids: list[int] = []
                    whole = value.as_py() or ""
                    for piece in windows(whole, step) if codes.cuts else [whole]:
                        ids += codes.encode(piece)
                    for k in out:
                        made[k].append(_field(k, codes, ids))
                columns = [part.column(i) for i in range(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[k], FIELDS[k][1]) for k in out)], names=schema.names)

    return source.mapInArrow(rows, schema)


def _field(name: str, codes: Codec, ids: list[int]):
    if name == "n_tokens":
        return len(ids)
    if name == "token_ids":
        return ids
    if name == "ids_sha256":
        return hashlib.sha256(",".join(map(codes.digits.__getitem__, ids)).encode()).hexdigest()
    if name == "decoded":
        return "".join(codes.decode(ids))
    digest = hashlib.sha256()
    for text in codes.decode(ids):
        digest.update(text.encode())
    return digest.hexdigest()
