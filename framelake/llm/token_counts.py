"""Token counts by finite-state transducers compiled from a BPE tokenizer.

Two machines are compiled from the tokenizer's file (a ``tokenizers`` file with word ends, as
``word_bpe_49k.json``), and the library counts no token.

The first splits text into pre-tokens: seven states over classes of normalised characters, whose
transitions say where pre-tokens open and close. The second counts the tokens of a pre-token. BPE has
a local test: two neighbouring tokens stand as they are unless some merge joins a right part of the
one to a left part of the other before these parts are merged inwards. So the last token of every
prefix follows from the last tokens of the shorter prefixes within reach of the longest token, and
its count is theirs plus one. A state is the longest end of what was read that begins a token, with
the last tokens and the relative counts of the prefixes that end in it; a transition emits by how much
the count changes, and a closing transition what the last letter with its word end adds. States and
transitions are determinised when a text first takes them.

A text is cut into chunks that run side by side. A chunk does not know the state it is entered in,
so the first pass computes its whole state map (exit state for each entry state). A parallel prefix
scan, in as many rounds as the logarithm of the number of chunks, composes the maps and so gives
every chunk its entry state; the second pass marks the closing transitions of all chunks. The counting
machine is back in its start state at every pre-token, so what it emits is added up over chunks as it
is. Counts of pre-tokens are kept in a bounded table; a hash finds an entry, all characters confirm it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 512  #: characters of a chunk
BATCH_CHARS = 1 << 20  #: characters run side by side
MAX_WORDS = 1 << 19  #: annotated pre-tokens kept
END = 0x110000  #: padding behind a text
START, LETTERS, SYMBOLS, APOSTROPHE, APOS_R, APOS_V, APOS_L = range(7)
SPACE, LETTER, NUMBER, SYMBOL = range(4)
CLASSES = 12
#: Classes of characters: the four kinds, the apostrophe, and letters that end or continue a contraction.
_SPECIAL = {"'": 4, "s": 5, "t": 5, "m": 5, "d": 5, "r": 6, "v": 7, "l": 8, "e": 9}
_KIND = [SPACE, LETTER, NUMBER, SYMBOL, SYMBOL, *[LETTER] * 5]
MAX_STATES = 1 << 18  #: states of the counting machine kept; four times as many transitions
#: How a file must normalise and split texts for the machine compiled here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
OPENS, OPENED_BEFORE = 1, 2  #: outputs: a pre-token opens here; one opened at the character before


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """Transition and output tables of the splitter 's|'t|'re|'ve|'m|'ll|'d|letters|number|symbols."""
    after, output = np.zeros((7, CLASSES), np.int8), np.zeros((7, CLASSES), np.int8)

    def opening(c: int) -> tuple[int, int]:
        kind = _KIND[c]
        return {SPACE: (START, 0), NUMBER: (START, OPENS), LETTER: (LETTERS, OPENS), SYMBOL: (SYMBOLS, OPENS)}[kind] if c != 4 else (APOSTROPHE, OPENS)

    for c, kind in enumerate(_KIND):
        for state in range(7):
            to, out = opening(c)
            if state == LETTERS and kind == LETTER or state in (SYMBOLS, APOSTROPHE) and kind == SYMBOL:
                to, out = (LETTERS if kind == LETTER else SYMBOLS), 0
            elif state == APOSTROPHE and c == 5:
                to, out = START, 0
            elif state == APOSTROPHE and c in (6, 7, 8):
                to, out = {6: APOS_R, 7: APOS_V, 8: APOS_L}[c], 0
            elif state in (APOS_R, APOS_V) and c == 9 or state == APOS_L and c == 8:
                to, out = START, 0
            elif state in (APOS_R, APOS_V, APOS_L):  # no contraction after all: the letter before opened a word
                to, out = (LETTERS, OPENED_BEFORE) if kind == LETTER else (to, out | OPENED_BEFORE)
            after[state, c], output[state, c] = to, out
    after[:, CLASSES - 1] = START  # the end of a text
    output[[APOS_R, APOS_V, APOS_L], CLASSES - 1] = OPENED_BEFORE
    return after, output


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level BPE."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class BpeCounter:
    """The counting machine: tokens of a pre-token, given as a string of the byte alphabet."""

    def __init__(self, path: str):
        told = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model, steps = told["model"], (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
        if model["type"] != "BPE" or any(model.get(x) for x in ("continuing_subword_prefix", "dropout", "ignore_merges", "byte_fallback")):
            raise ValueError(f"{path} is no plain BPE model")
        if told.get("normalizer") != NORMALIZER or len(steps) != 2 or steps[0] != SPLIT or not steps[1].items() >= BYTES.items():
            raise ValueError(f"{path} normalises or splits texts in another way than the compiled machine")
        if any(t.get(x) for t in told.get("added_tokens") or [] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that are not found as they stand")
        self.end = model.get("end_of_word_suffix") or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}  # of a token: the merge that makes it
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((left, right), i)
            self.parts.setdefault(left + right, (left, right, i))
        self.begins = {t[:n] for t in (t.removesuffix(self.end) for t in self.vocabulary) for n in range(len(t) + 1)}
        self.stand: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        # the start: nothing read, no last token, count 0
        self.states: dict[tuple, int] = {("", ("",), (0,)): 0}
        self.known: list[tuple] = list(self.states)
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.closings: dict[tuple[int, str], int] = {}

    def edge(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The parts on one side of a token, outermost first, each with the rank at which it is merged inwards."""
        out, until = [], float("inf")
        while token:
            out.append((token, until))
            left, other, until = self.parts.get(token, ("", "", 0))
            token = other if right else left
        return out

    def stands(self, a: str, b: str) -> bool:
        """Whether token ``b`` may follow token ``a``: no merge joins them earlier than their own parts are joined."""
        if not a:
            return True
        found = self.stand.get((a, b))
        if found is None:
            rank, left_side = self.rank.get, self.edge(b, False)
            found = True
            for x, x_until in self.edge(a, True):
                for y, y_until in left_side:
                    r = rank((x, y))
                    if r is not None and r < x_until and r <= y_until:  # of one rank the merge farther left comes first
                        found = False
            if len(self.stand) > MAX_STATES:
                self.stand.clear()
            self.stand[a, b] = found
        return found

    def last(self, state: tuple, symbol: str, end: str) -> tuple[str, int]:
        """The last token of what was read and ``symbol``, and its count less that of what was read."""
        read, lasts, counts = state
        for at in range(len(read) + 1):  # the longest token first
            token = read[at:] + symbol + end
            if token in self.vocabulary and self.stands(lasts[at], token):
                return token, counts[at] + 1
        raise ValueError(f"no token ends in {symbol!r}")

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        read, lasts, counts = self.known[state]
        token, more = self.last(self.known[state], symbol, "")
        read, lasts, counts = read + symbol, (*lasts, token), (*(c - more for c in counts), 0)
        cut = 0
        while read[cut:] not in self.begins:
            cut += 1
        after = read[cut:], lasts[cut:], counts[cut:]
        number = self.states.setdefault(after, len(self.states))
        if number == len(self.known):
            self.known.append(after)
        self.steps[state, symbol] = number, more
        return number, more

    def count(self, word: str) -> int:
        if len(self.known) > MAX_STATES or len(self.steps) + len(self.closings) > 4 * MAX_STATES:
            self.forget()
        state, total, steps = 0, 0, self.steps
        for symbol in word[:-1]:
            found = steps.get((state, symbol)) or self.step(state, symbol)
            state, more = found
            total += more
        key = state, word[-1]
        more = self.closings.get(key)
        if more is None:
            more = self.closings[key] = self.last(self.known[state], word[-1], self.end)[1]
        return total + more


class CountingTransducer:
    """The compiled machines; ``counts(texts)`` gives the tokens of each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.machine = BpeCounter(path)  # looks at the file first
        tokenizer = Tokenizer.from_file(path)
        self.split, self.normal = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.normalizer.normalize_str
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.mark = os.path.commonprefix(special)  # what a text with a special token holds
        self.alphabet = byte_alphabet()
        self.after, self.output = _compile()
        self.cls = np.full(END + 1, -1, np.int8)
        self.cls[END] = CLASSES - 1
        random = np.random.default_rng(49_000)
        self.value = random.integers(1, 1 << 63, END + 1, np.uint64)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.words: dict[int, tuple[bytes, int]] = {}

    def tokens(self, word: bytes) -> int:
        """Tokens of a pre-token in UTF-32."""
        return self.machine.count("".join([self.alphabet[b] for b in word.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")]))

    def learn(self, code: int) -> None:
        """The class of a character, asked of the tokenizer's own splitter."""
        c = chr(code)
        n = len(self.split(f"a{c}a"))
        kind = LETTER if n == 1 else SPACE if n == 2 else NUMBER if len(self.split(c + c)) == 2 else SYMBOL
        self.cls[code] = _SPECIAL.get(c, kind)

    def segments(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in a text, and the normalised stretches between them."""
        parts = self.special.split(text) if self.special and self.mark in text else [text]
        made = []
        for p in parts:
            made.append(p.lower() if p.isascii() else self.normal(p))
        return len(parts) - 1, made

    def counts(self, texts: list[str | None]) -> np.ndarray:
        total, todo, owner, chars = np.zeros(len(texts), np.int64), [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            n, parts = self.segments(text)
            total[i] += n
            for p in parts:
                if p:
                    todo.append(p)
                    owner.append(i)
                    chars += len(p)
            if chars >= BATCH_CHARS:
                np.add.at(total, owner, self.batch(todo))
                todo, owner, chars = [], [], 0
        if todo:
            np.add.at(total, owner, self.batch(todo))
        return total

    def entries(self, cls: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """Entry state of every chunk: state maps of all chunks, composed by a prefix scan."""
        maps = np.repeat(np.arange(7, dtype=np.int8)[:, None], cls.shape[1], 1)
        for row in cls:
            maps = self.after[maps, row]
        reach, start = 1, np.flatnonzero(opening)
        begin = start[np.cumsum(opening) - 1]  # the first chunk of each chunk's text
        at = np.arange(len(opening))
        while reach < len(at):
            more = np.flatnonzero(at - reach >= begin)  # compose with the map of the chunks before
            if not len(more):
                break
            maps[:, more] = maps[maps[:, more - reach], more]
            reach *= 2
        return np.where(opening, START, np.concatenate([[START], maps[START, :-1]]))

    def batch(self, parts: list[str]) -> np.ndarray:
        raw = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in parts]
        lanes = np.array([len(r) // CHUNK + 1 for r in raw])  # at least one place of padding behind each
        first = np.concatenate([[0], np.cumsum(lanes)[:-1]])
        flat = np.full(int(lanes.sum()) * CHUNK, END, np.uint32)
        for r, at in zip(raw, first.tolist(), strict=True):
            flat[at * CHUNK : at * CHUNK + len(r)] = r
        cls = self.cls[flat]
        if (unknown := flat[cls < 0]).size:
            for code in np.unique(unknown).tolist():
                self.learn(code)
            cls = self.cls[flat]
        opening = np.zeros(int(lanes.sum()), bool)
        opening[first] = True
        by_step = np.ascontiguousarray(cls.reshape(-1, CHUNK).T)
        state = self.entries(by_step, opening).astype(np.int8)
        marks = np.empty_like(by_step)
        for row, mark in zip(by_step, marks, strict=True):
            mark[:] = self.output[state, row]
            state = self.after[state, row]
        marks = np.ascontiguousarray(marks.T).reshape(-1)
        opens = (marks & OPENS).astype(bool)
        opens[:-1] |= (marks[1:] & OPENED_BEFORE).astype(bool)
        starts = np.flatnonzero(opens)
        if not len(starts):
            return np.zeros(len(parts), np.int64)
        edges = np.flatnonzero(opens | (cls == SPACE) | (cls == CLASSES - 1))
        ends = edges[np.searchsorted(edges, starts) + 1]
        emitted = self.annotations(flat, starts, ends)
        total = np.concatenate([[0], np.cumsum(emitted)])
        cuts = np.searchsorted(starts, np.append(first, lanes.sum()) * CHUNK)
        return total[cuts[1:]] - total[cuts[:-1]]

    def annotations(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token, by the counting machine."""
        size = ends - starts
        hashes = size.astype(np.uint64)
        widest = min(int(size.max()), 24)
        live = [np.flatnonzero(size > i) if i else slice(None) for i in range(widest)]
        with np.errstate(over="ignore"):
            for i in range(widest):  # short ones, a character of all at a time
                hashes[live[i]] = (hashes[live[i]] ^ self.value[flat[starts[live[i]] + i]]) * self.base
                hashes[live[i]] ^= hashes[live[i]] >> np.uint64(29)
            for j in np.flatnonzero(size > 24).tolist():
                hashes[j] ^= np.uint64(hash(flat[starts[j] : ends[j]].tobytes()) & (1 << 63) - 1)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        word = lambda j: flat[starts[j] : ends[j]].tobytes()
        # pre-tokens that share a hash share all characters, or else are counted one by one
        like = where[inverse]
        same = size == size[like]
        for i in range(widest):
            rows = live[i]
            same[rows] &= flat[starts[rows] + i] == flat[starts[like[rows]] + i if i else starts[like] + i]
        for j in np.flatnonzero((size > 24) & (like != np.arange(len(size)))).tolist():
            same[j] &= word(j) == word(like[j])
        known, out = self.words, np.empty(len(distinct), np.int64)
        for k, (h, j) in enumerate(zip(distinct.tolist(), where.tolist(), strict=True)):
            w = word(j)
            found = known.get(h)
            if found is None or found[0] != w:
                if len(known) >= MAX_WORDS:
                    known.clear()
                found = known[h] = w, self.tokens(w)
            out[k] = found[1]
        total = out[inverse]
        for j in np.flatnonzero(~same).tolist():
            total[j] = self.tokens(word(j))
        return total


_machines: dict[str, CountingTransducer] = {}


def _machine(path: str) -> CountingTransducer:
    if path not in _machines:
        _machines[path] = CountingTransducer(path)
    return _machines[path]


def n_tokens(text: Column | str, path: str) -> Column:
    """Column with the tokens of a text (null: 0) under the tokenizer file ``path``, which every executor has."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _machine(path)
        for s in batches:
            yield pd.Series(machine.counts(s.tolist()))

    return counted(text)


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048, prefix: str = "") -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` to every row, without any shuffle.

    Null and empty texts have no bytes and no tokens. Columns already named so are replaced; with a
    ``prefix`` the new ones are named apart. Texts of any length are counted whole; rows with equal
    texts or ids are counted each on its own; an empty table gives an empty one.
    """
    filled = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn(f"{prefix}n_bytes", F.octet_length(filled).cast("long"))
        .withColumn(f"{prefix}n_tokens", n_tokens(filled, path))
        .withColumn(f"{prefix}over_limit", F.col(f"{prefix}n_tokens") > limit)
    )
