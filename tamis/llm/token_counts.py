"""Token counts by a tokenizer compiled into a finite-state transducer.

The word splitter and the byte-pair merges become one deterministic transducer over characters, whose
transitions carry the number of tokens they emit. It is compiled as far as the texts need it. A state
holds what the merges can still depend on: for each place where an unfinished token may have begun, the
token before it and the count up to it. (A sequence of tokens is the tokenizer's own exactly if each
neighbouring pair is, so nothing further back matters.)

Texts are cut into chunks that run in parallel. White space leads every state to the same one, so the
state map of a chunk is constant after its first white space: chunks run from there at once, then their
heads run from the states that a scan over the chunk maps gives them.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm.common import text_slices
from tamis.llm.tokenizing import tokenizer_file

CHUNK = 256  # characters
PIECE = 7_800 * CHUNK  # characters of one text that run at a time
TABLE_BYTES = 96_000_000  # the compiled table is dropped and compiled anew beyond that
LAST_CODE = 0x2E80  # words with later code points are counted by the tokenizer itself
SPECIAL = "\U0010ffff"  # stands for a special string
END = "</w>"
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
START, UNKNOWN = 0, 1


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Which tokens may follow each other under the merges of a byte-pair vocabulary."""

    def __init__(self, model: dict):
        self.vocab = set(model["vocab"])
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: n for n, pair in enumerate(pairs)}
        self.prefixes = {t[:n] for t in self.vocab for n in range(1, len(t.removesuffix(END)) + 1)}
        self.seen: dict[tuple[str | None, str], bool] = {}

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def _merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            ranked = [self.ranks.get(p, 1 << 30) for p in zip(symbols, symbols[1:], strict=False)]
            least = min(ranked)
            if least == 1 << 30:
                break
            at = ranked.index(least)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def follows(self, before: str | None, token: str) -> bool:
        """Whether ``token`` comes after ``before`` (None: begins a word)."""
        known = self.seen.get((before, token))
        if known is None:
            if len(self.seen) > 400_000:
                self.seen.clear()
            own = self._symbols(token)
            if before is None:
                known = self._merged(own) == [token]
            else:
                known = self.follows(None, token) and self._merged(list(before) + own) == [before, token]
            self.seen[before, token] = known
        return known


class Transducer:
    """Counts the tokens of texts; see the module's description."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        path = tokenizer_file(name)
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["model"]["end_of_word_suffix"] != END:
            raise ValueError(f"{name} is not a lower-casing byte-pair vocabulary with word ends")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(spec["model"])
        self.bytes = _byte_symbols()
        self.columns = np.full(0x110000, -1, dtype=np.int16)
        self.columns[LAST_CODE:] = -2
        self.chars: list[str] = []
        for c in SPACES:
            self._column(ord(c))
        self.space = int(self.columns[32])
        self.columns[ord(SPECIAL)] = len(self.chars)
        self.chars.append(SPECIAL)
        self._reset()

    # Characters

    def _column(self, code: int) -> None:
        c = chr(code)
        if c in SPACES:
            c = " "
        lower = c.lower()
        if len(lower) != 1 or unicodedata.category(c) in ("Cn", "Cs"):
            self.columns[code] = -2
            return
        if lower not in self.chars:
            self.chars.append(lower)
        self.columns[code] = self.chars.index(lower)

    @staticmethod
    def _kind(c: str) -> str:
        if c in SPACES:
            return " "
        kind = unicodedata.category(c)[0]
        return kind if kind in "LN" else "O"

    # Compilation: a state is (mode, context); a context is (suffix, ((length, before, count), ...))

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {("start", None): START, ("unknown", None): UNKNOWN}
        self.keys: list[tuple] = list(self.states)
        self.table = np.full((1024, len(self.chars) + 8), -1, dtype=np.int32)

    _root = ("", ((0, None, 0),))

    def _advance(self, context: tuple, c: str) -> tuple[tuple, int]:
        """The context after one more character of a word, and the tokens this adds."""
        added = 0
        for b in c.encode():
            suffix, begun = context
            suffix += self.bytes[b]
            longest, last, delta, kept = 0, None, None, []
            for length, before, count in begun:
                own = suffix[len(suffix) - length - 1 :]
                if own in self.merges.prefixes:
                    kept.append((length + 1, before, count))
                    longest = max(longest, length + 1)
                if delta is None and own in self.merges.vocab and self.merges.follows(before, own):
                    last, delta = own, count + 1
            if delta is None:
                raise ValueError(f"no token ends after {suffix!r}")
            kept = [(n, before, count - delta) for n, before, count in kept]
            context = (suffix[len(suffix) - longest :], (*kept, (0, last, 0)))
            added += delta
        return context, added

    def _finish(self, context: tuple) -> int:
        """The tokens that the end of the word adds."""
        suffix, begun = context
        for length, before, count in begun:
            own = suffix[len(suffix) - length :] + END
            if length and own in self.merges.vocab and self.merges.follows(before, own):
                return count + 1
        raise ValueError(f"no token ends the word after {suffix!r}")

    def _step(self, state: tuple, c: str) -> tuple[tuple, int]:
        mode, context = state
        kind = self._kind(c) if c != SPECIAL else " "
        if mode == "start":
            if c == SPECIAL:
                return state, 1
            if kind == " ":
                return state, 0
            context, added = self._advance(self._root, c)
            if kind == "N":  # a word by itself
                return ("start", None), added + self._finish(context)
            return ("'" if c == "'" else kind, context), added
        if mode == kind:  # a run of letters, or of other characters
            context, added = self._advance(context, c)
            return (mode, context), added
        if mode == "'":
            if c in "stmd":
                context, added = self._advance(context, c)
                return ("start", None), added + self._finish(context)
            if c in "rvl":
                return (c, context), 0
            if kind == "O":
                context, added = self._advance(context, c)
                return ("O", context), added
        if mode in "rvl" and c == ("l" if mode == "l" else "e"):
            context, first = self._advance(context, mode)
            context, second = self._advance(context, c)
            return ("start", None), first + second + self._finish(context)
        added = self._finish(context)
        after = ("start", None)
        if mode in "rvl":  # the letter begins a word
            after, more = self._step(after, mode)
            added += more
        after, more = self._step(after, c)
        return after, added + more

    def _compile(self, state: int, column: int) -> int:
        c = self.chars[column]
        if state == UNKNOWN:
            resets = c == SPECIAL or c in SPACES
            after, added = (("start", None), 0) if resets else (("unknown", None), 0)
        else:
            after, added = self._step(self.keys[state], c)
        number = self.states.setdefault(after, len(self.keys))
        if number == len(self.keys):
            self.keys.append(after)
            if number == len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table[: max(1024, number // 4)], -1)])
        value = number << 8 | added + 128
        self.table[state, column] = value
        return value

    # Running

    def _moves(self, states: np.ndarray, columns: np.ndarray) -> np.ndarray:
        moves = self.table[states, columns]
        missing = np.flatnonzero(moves < 0)
        if len(missing):
            for pair in {*zip(states[missing].tolist(), columns[missing].tolist(), strict=True)}:
                self._compile(*pair)
            moves = self.table[states, columns]
        return moves

    def _chunks(self, columns: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run each chunk (a column of ``columns``) from its state: states at the end, and counts."""
        counts = np.zeros(len(states), dtype=np.int64)
        for row in columns:
            moves = self._moves(states, row)
            states = moves >> 8
            counts += (moves & 255) - 128
        return states, counts

    def _run(self, codes: list[np.ndarray], states: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of texts given as columns, each from a state, and the states after them."""
        if self.table.shape[1] < len(self.chars):
            wider = np.full((len(self.table), len(self.chars) + 8), -1, dtype=np.int32)
            wider[:, : self.table.shape[1]] = self.table
            self.table = wider
        each = np.array([max(1, -(-len(c) // CHUNK)) for c in codes])
        first = np.cumsum(each) - each
        # Padding is a column of its own that changes nothing.
        lanes = np.full((each.sum(), CHUNK), self.space, dtype=np.int16)
        for at, n, c in zip(first.tolist(), each.tolist(), codes, strict=True):
            lanes[at : at + n].reshape(-1)[: len(c)] = c
        begins = np.full(len(lanes), UNKNOWN)
        begins[first] = states
        columns = np.ascontiguousarray(lanes.T)
        ends, counts = self._chunks(columns, begins)

        # Heads: what comes before the first white space of a chunk that began in an unknown state.
        resets = (lanes == self.space) | (lanes == self.columns[ord(SPECIAL)])
        head = np.where(resets.any(axis=1), resets.argmax(axis=1) + 1, CHUNK)
        constant = resets.any(axis=1) | (begins != UNKNOWN)  # the end does not depend on the beginning
        todo = np.flatnonzero(begins == UNKNOWN)
        ready = todo[constant[todo - 1]]
        at, states_now = ready, ends[ready - 1]
        for step in range(CHUNK):
            on = head[at] > step
            at, states_now = at[on], states_now[on]
            if not len(at):
                break
            moves = self._moves(states_now, columns[step, at])
            states_now = moves >> 8
            counts[at] += (moves & 255) - 128
            open_ends = ~constant[at] & (head[at] == step + 1)
            ends[at[open_ends]] = states_now[open_ends]
        for lane in todo[~constant[todo - 1]].tolist():  # after chunks without any white space, in order
            state = int(ends[lane - 1])
            for column in lanes[lane, : head[lane]].tolist():
                move = int(self.table[state, column])
                if move < 0:
                    move = self._compile(state, column)
                state = move >> 8
                counts[lane] += (move & 255) - 128
            if not constant[lane]:
                ends[lane] = state
        return np.add.reduceat(counts, first), ends[first + each - 1]

    def _codes(self, text: str) -> tuple[np.ndarray, int]:
        """The columns of a text's characters, and the tokens of words with characters that have none.

        White space parts words that don't depend on each other, so such words go to the library by
        themselves and their places become white space.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        columns, apart = self.columns[codes], 0
        if not len(columns) or columns.min() >= 0:
            return columns, 0
        for code in np.unique(codes[columns == -1]).tolist():
            self._column(code)
        columns = self.columns[codes]
        rare = columns == -2
        ends = (columns == self.space) | (columns == self.columns[ord(SPECIAL)])
        word = np.cumsum(ends)
        for number in np.unique(word[rare]).tolist():
            start, end = np.searchsorted(word, [number, number + 1]).tolist()
            start += bool(ends[start])
            apart += self._exactly(text[start:end])
            columns[start:end] = self.space
        return columns, apart

    def _exactly(self, text: str) -> int:
        return len(self.exact.encode(text, add_special_tokens=False).ids)

    def count(self, texts: list[str]) -> list[int]:
        if self.table.nbytes > TABLE_BYTES:
            self._reset()
        counts, codes, at = [0] * len(texts), [], []
        for n, text in enumerate(texts):
            if SPECIAL in text:  # no character of a text
                counts[n] = self._exactly(text)
                continue
            marked = text if text.isascii() else unicodedata.normalize("NFC", text)
            for special in self.special:
                marked = marked.replace(special, SPECIAL)
            own, counts[n] = self._codes(marked)
            if len(own) > PIECE:
                counts[n] += self._long(own)
            else:
                codes.append(np.append(own, np.int16(self.space)))  # ends the last word
                at.append(n)
        if codes:
            for n, found in zip(at, self._run(codes, [START] * len(codes))[0].tolist(), strict=True):
                counts[n] += found
        return counts

    def _long(self, codes: np.ndarray) -> int:
        total, state = 0, START
        for start in range(0, len(codes), PIECE):  # whole chunks, but for the last piece
            found, ends = self._run([codes[start : start + PIECE]], [state])
            total, state = total + int(found[0]), int(ends[0])
        return total + int(self._run([np.array([self.space], np.int16)], [state])[0][0])


@functools.lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    return Transducer(name)


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = 2048,
    tokenizer: str = "word_bpe_49k.json",
) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows and null ids are kept; other
    columns are not read. Special strings in a text count as one token each, as in the library. Words
    with code points from U+2E80 on, or with characters that have no single lower-case form, are
    counted by the library itself; all other words of such texts run through the transducer.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_bytes", T.LongType()),
         T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(tokenizer)
        for part in text_slices(batches, "text"):
            texts = part["text"].to_pylist()
            counts = np.array(counter.count([t or "" for t in texts]), dtype=np.int64)
            sizes = pa.compute.fill_null(pa.compute.binary_length(part["text"]), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), sizes.combine_chunks(), pa.array(counts),
                 pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, schema)
