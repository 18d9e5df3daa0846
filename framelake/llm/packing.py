"""Packing token sequences by best-fit decreasing.

A document's tokens are first cut into full windows; what is left over is a piece shorter than a
window. Pieces are taken in order of decreasing length, and each goes into the open window whose
free room is least but enough. A segment tree indexed by free room finds that window: a leaf holds
the open windows with just that much room, an inner node says whether any leaf below has one.

Each task packs the documents of its own partition, in blocks of a bounded number of tokens, so
memory does not depend on the input; windows that a block leaves open are offered to the next block
of the task. What a task leaves far from full at its end goes to a second pass: the pieces of such
windows, as rows of three numbers without their ids, are gathered from all tasks, dealt to as few
tasks as bounded blocks allow, and packed by best fit again. So padding does not depend on how the
input is partitioned.

Ids come from ``tokenizers``. A pre-token of byte-level BPE never reaches over a blank that stands
before a character other than white space, so a text is cut there, and the ids of each such word are
asked of the tokenizer once and kept in a bounded table: those of plain pre-tokens of its model, others
of the whole tokenizer. Texts with special tokens are encoded whole, and so are all texts under a file
that normalises or splits them in another way.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.token_counts import byte_alphabet
from framelake.runtime import batches_of, join_lookup, staged

WINDOW = 1024
BLOCK_TOKENS = 4_000_000  #: tokens packed at a time (16 MB)
LOOSE = 1 / 32  #: share of a window that may stay empty before it goes to the second pass
BLOCK_PIECES = 500_000  #: pieces of the second pass packed at a time
WORD_MEMO, WORD_CHARS = 1 << 20, 64  #: words (and pre-tokens) kept, about 400 MB of a worker with long texts, and a word's characters at most
GROUP_CHARS = 1 << 18  #: characters of texts split at a time
_GAP, _WIDE = re.compile(r" (?=\S)"), re.compile(r" (?!\S)")
#: Letters and then signs, on one line or two: each group is a pre-token of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?(?:(\n)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)?)?")


class RoomTree:
    """Open windows by free room (0 to ``capacity``), with the tightest fit in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free room, window) of the tightest open window with room for ``need``, taken out; or None."""
        node = need + self.leaves
        if need >= len(self.open):
            return None
        if not self.any[node]:  # climb until a right sibling has a window, then go down leftmost
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (not self.any[2 * node])
        room = node - self.leaves
        window = self.open[room].pop()
        while node and not (self.open[room] if node >= self.leaves else self.any[2 * node] | self.any[2 * node + 1]):
            self.any[node] = 0
            node >>= 1
        return room, window


def best_fit(lengths: np.ndarray, capacity: int, tree: RoomTree, next_window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset) of each piece, and the first window number not yet used; ``tree`` keeps open windows."""
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need) if need < capacity else None
        if found is None:
            found = capacity, next_window
            next_window += 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > need:
            tree.put(room - need, int(window[i]))
    return window, offset, next_window


class WordEncoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit, under a byte-level BPE ``tokenizers`` file."""

    def __init__(self, path: str, memo: int = WORD_MEMO):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.stand_ins = self.tokenizer.model, dict(enumerate(byte_alphabet()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False}
        plain = not told.get("normalizer") and not told.get("truncation") and not told.get("padding") and told["model"]["type"] == "BPE"
        #: whether words may be encoded apart: byte-level BPE by its own splitter, on texts as they are
        self.apart = bool(plain and (told.get("pre_tokenizer") or {}).items() >= byte_level.items() and (told["pre_tokenizer"].get("use_regex", True)))
        self.memo = memo
        self.words: dict[str, bytes] = {}  # words that stand behind a blank
        self.pieces: dict[str, bytes] = {}  # single pre-tokens without a blank

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, x: str) -> bytes:
        """Ids of a single pre-token, by the tokenizer's model alone."""
        return self.spelt(x.encode().decode("latin-1").translate(self.stand_ins))

    def spelt(self, x: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(x)]).tobytes()

    def part(self, x: str) -> bytes:
        found = self.pieces.get(x)
        if found is None:
            found = self.piece(x)
            if len(x) <= WORD_CHARS:
                self.pieces[x] = found
        return found

    def learn(self, words: set[str]) -> None:
        """Keep ids of new words behind a blank: by their pre-tokens where those are plain, else as the library splits them."""
        known, odd, blank = self.words, [], self.stand_ins[ord(" ")]
        for w in words:
            if w.isascii() and w.isalpha():
                known[w] = self.spelt(blank + w)
            elif m := _PLAIN.fullmatch(w):
                head, *rest = filter(None, m.groups())
                ids = known.get(head)
                if ids is None:
                    ids = self.piece(" " + head)
                    if len(head) <= WORD_CHARS:
                        known[head] = ids
                known[w] = ids + b"".join(map(self.part, rest))
            else:
                odd.append(w)
        known.update(zip(odd, self.ids([" " + w for w in odd]), strict=True))

    def group(self, texts: list[str]) -> list[bytes]:
        words = [_GAP.split(t) if _WIDE.search(t) else t.split(" ") for t in texts]
        firsts = self.ids([w.pop(0) for w in words])
        found = [list(map(self.words.get, w)) for w in words]
        missing = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        new = {w[i] for w, m in zip(words, missing, strict=True) for i in m}
        self.learn(new)
        for w, f, m in zip(words, found, missing, strict=True):
            for i in m:
                f[i] = self.words[w[i]]
        for w in [w for w in new if len(w) > WORD_CHARS]:
            del self.words[w]
        if len(self.words) > self.memo:
            self.words.clear()
        if len(self.pieces) > self.memo:
            self.pieces.clear()
        return [first + b"".join(f) for first, f in zip(firsts, found, strict=True)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, worked out for a bounded number of characters (or one text) at a time."""
        held, chars = [], 0
        for text in texts:
            if not self.apart or any(s in text for s in self.special):
                yield from self.group(held)
                yield from self.ids([text])
                held, chars = [], 0
                continue
            held.append(text)
            chars += len(text)
            if chars >= GROUP_CHARS:
                yield from self.group(held)
                held, chars = [], 0
        yield from self.group(held)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, memo: int) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
    if (path, memo) not in _encoders:
        _encoders[path, memo] = WordEncoder(path, memo)
    return _encoders[path, memo]


PIECE = T.StructType(
    [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))]
)


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, block_tokens: int = BLOCK_TOKENS, memo: int = WORD_MEMO) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece.

    Columns: ``key``, ``start`` (the document's ids before the piece), ``length``, ``ids`` (binary,
    little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset`` (of the piece in its
    sequence; pieces fill it without gaps). A document is its ids and ``end_id``; a null or empty
    text is ``end_id`` alone. Special strings in texts are the tokenizer's special tokens. Every id
    is in one piece. Equal keys, null keys and repeated rows are documents of their own. An empty
    table gives an empty one; other columns are not read. Sequence numbers start at the number of
    the task times 2**36 (those of the second pass are negative), so they are unique, and a task that
    is run again gives the same ones. ``memo`` words are kept by a worker: fewer take less memory and
    more time, and give the same rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(path, memo)
        end = np.uint32(end_id).astype("<u4").tobytes()
        tree, next_window = RoomTree(window), TaskContext.get().partitionId() << 36
        used: dict[int, int] = {}  # of windows that are not full
        keys, ids, held = [], [], 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal next_window, held
            pieces = [(i, at, min(window, len(x) // 4 - at)) for i, x in enumerate(ids) for at in range(0, len(x) // 4, window)]
            lengths = np.array([p[2] for p in pieces], np.int64)
            to, offset, next_window = best_fit(lengths, window, tree, next_window)
            for w, top in zip(to.tolist(), (offset + lengths).tolist(), strict=True):
                used[w] = max(used.get(w, 0), top)
            for w in [w for w, n in used.items() if n >= window * (1 - LOOSE)]:
                del used[w]
            for lo in range(0, len(pieces), 2000):
                part = pieces[lo : lo + 2000]
                yield pd.DataFrame(
                    {
                        "key": pd.Series([keys[i] for i, _, _ in part], dtype=object),
                        "start": [at for _, at, _ in part],
                        "length": [n for _, _, n in part],
                        "ids": [ids[i][4 * at : 4 * (at + n)] for i, at, n in part],
                        "doc_tokens": [len(ids[i]) // 4 for i, _, _ in part],
                        "sequence_id": to[lo : lo + 2000],
                        "offset": offset[lo : lo + 2000],
                        "used": None,
                    }
                )
            keys.clear()
            ids.clear()
            held = 0

        for batch in batches:
            for k, x in zip(batch["key"].tolist(), encode(batch["text"].tolist()), strict=True):
                keys.append(None if pd.isna(k) else k)
                ids.append(x + end)
                held += len(ids[-1]) // 4
            if held >= block_tokens:
                yield from flush()
        if ids:
            yield from flush()
        if used:  # rows of another kind: what this task leaves far from full
            names = ["key", "start", "length", "ids", "doc_tokens"]
            yield pd.DataFrame({**dict.fromkeys(names), "sequence_id": list(used), "offset": 0, "used": pd.Series(list(used.values()), dtype="Int64")})

    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *PIECE.fields, T.StructField("used", T.LongType())])
    with batches_of(spark, 500):
        made = staged(rows.mapInPandas(packed, schema))
    pieces, loose = made.where("used is null").drop("used"), made.where("used is not null").select("sequence_id")
    opened = join_lookup(pieces.select("sequence_id", "offset", "length"), loose, ["sequence_id"], "left_semi")
    moves = staged(_second_pass(staged(opened), window))
    found = join_lookup(pieces, moves, ["sequence_id", "offset"])
    moved = found.withColumns({"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.coalesce("at", "offset")})
    return moved.select(F.col("key").alias(key), *PIECE.names)


def _second_pass(pieces: DataFrame, window: int) -> DataFrame:
    """``(sequence_id, offset, into, at)``: the new places of pieces, which are told apart by their old ones.

    New sequences have negative numbers, which the first pass does not use.
    """
    parts = -(-pieces.count() // BLOCK_PIECES) or 1

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = -(TaskContext.get().partitionId() << 36) - 1
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("sequence_id", "offset", "length")})
        whole = pd.concat([empty, *batches], ignore_index=True).sort_values(["sequence_id", "offset"], kind="stable")
        to, at, _ = best_fit(whole["length"].to_numpy(np.int64), window, RoomTree(window), 0)
        yield pd.DataFrame({"sequence_id": whole["sequence_id"], "offset": whole["offset"], "into": first - to, "at": at})

    dealt = pieces.repartition(parts, F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(parts)))
    return dealt.mapInPandas(packed, "sequence_id long, offset long, into long, at long")
