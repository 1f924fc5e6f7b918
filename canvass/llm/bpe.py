"""Byte-pair encoding and decoding by dynamic programming over prefixes (operator 2).

For every prefix of a piece there is exactly one last token of its encoding.  An automaton over
all tokens gives those that end at a position; the right one is the one that can stand after
the last token of the prefix before it, which a test of the pair alone decides: undoing the
merges of the two tokens from the latest on, no earlier merge may join them across the border.
Following the last tokens backwards gives the ids.  Texts are cut into pieces first, as the
vocabulary's pre-tokenizer does, and pieces seen before are looked up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.shared import prepare

# Fixed value: the split pattern of byte-level vocabularies, blanks as the Unicode property.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space beside another blank: only there does a cut before each space part a piece.
RUN = re.compile(f" [{BLANK}]|[{BLANK}] ")
#: Pieces or words, and pairs, of each of the two generations that a worker remembers, and the longest text remembered.
PIECES, PAIRS, LONGEST = 100_000, 100_000, 64


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file: printable ones
    stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens are numbered by age: the 256 bytes, then the merges in their order."""

    def __init__(self, text: str) -> None:
        file = json.loads(text)
        model, letters = file["model"], letters_of_bytes()
        ids = model["vocab"]
        if model["type"] != "BPE" or file["normalizer"] or file["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE vocabularies are supported")
        names = {b: c for c, b in letters.items()}
        words = [names[b] for b in range(256)]
        number = {w: n for n, w in enumerate(words)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.pair: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if left + right in number:
                raise ValueError("a token has two merges")
            self.pair[number[left], number[right]] = number[left + right] = len(words)
            self.parts.append((number[left], number[right]))
            words.append(left + right)
        self.ids = np.array([ids[w] for w in words], np.int32)
        self.packed = [i.tobytes() for i in self.ids]
        self.bytes = [bytes(letters[c] for c in w) for w in words]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        table = {int(i): b for i, b in zip(self.ids, self.bytes, strict=True)} | {i: s.encode() for s, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.length = np.array([len(p) for p in parts], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.content = np.frombuffer(b"".join(parts), np.uint8)
        self.after = Remembered(self._follows, PAIRS)
        whole = [True] * 256
        self.automaton = ahocorasick.Automaton()
        for n, b in enumerate(self.bytes):
            if n >= 256:  # tokens whose own bytes are encoded otherwise never occur
                left, right = self.parts[n]
                whole.append(whole[left] and whole[right] and self._apart(left, right, n))
            if whole[n]:
                self.automaton.add_word(b.decode("latin-1"), (n, len(b)))
        self.automaton.make_automaton()
        self.last, self.sizes = [], []
        self.pieces, self.words = Remembered(self._piece, PIECES), Remembered(self._word, PIECES)

    def _follows(self, pair: int) -> bool:
        """Whether the right token of a pair can follow the left one: no merge joins parts of both before they are made."""
        return self._apart(pair >> 24, pair & 0xFFFFFF, None)

    def _apart(self, left: int, right: int, made: int | None) -> bool:
        """Undo the merges of both from the latest on; no older pair may cross the border.

        With ``made``, the two are the parts of that token, whose own merge may cross.
        """
        before = len(self.parts) if made is None else made
        while True:
            crossing = self.pair.get((left, right))
            if crossing is not None and crossing < before:
                return False
            # of two merges the younger is undone; of one age the left one was made first
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def encode_piece(self, data: str) -> list[int]:
        """Numbers of the tokens of one piece, whose bytes are given as letters."""
        after, n = self.after, len(data)
        while len(self.last) < n:  # reused by all pieces
            self.last += [0] * n
            self.sizes += [0] * n
        last, sizes, done = self.last, self.sizes, -1
        for end, (token, size) in self.automaton.iter(data):
            if end != done and (end < size or after[last[end - size] << 24 | token]):
                last[end], sizes[end], done = token, size, end
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end -= sizes[end]
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else piece.encode().decode("latin-1")
        return b"".join([self.packed[n] for n in self.encode_piece(letters)])

    def _word(self, word: str) -> bytes:
        """Ids of a word with the space before it; what is one piece is remembered as a word only."""
        if word.isascii() and word.isalpha():
            return self._piece(" " + word)
        pieces = SPLIT.findall(" " + word)
        return self._piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.pieces.__getitem__, pieces))

    def _plain(self, text: str) -> list[bytes]:
        """Ids of a text without special tokens, cut before its spaces where that parts no piece."""
        if RUN.search(text):
            return list(map(self.pieces.__getitem__, SPLIT.findall(text)))
        first, *words = text.split(" ")
        return [*map(self.pieces.__getitem__, SPLIT.findall(first)), *map(self.words.__getitem__, words)]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens in it become their ids."""
        parts, rest = [], [text]
        for name in self.special:
            rest = [x for t in rest for x in parted(t, name)]
        for part in rest:
            if part in self.special:
                parts.append(np.int32(self.special[part]).tobytes())
            else:
                parts += self._plain(part)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        at = np.cumsum(size) - size
        return self.content[np.arange(size.sum()) + np.repeat(self.offset[ids] - at, size)].tobytes()


def parted(text: str, name: str) -> list[str]:
    """The text cut before and after each occurrence of a name."""
    if name not in text or text == name:
        return [text]
    return [x for k, part in enumerate(text.split(name)) for x in ((name, part) if k else (part,)) if x]


class Remembered(dict):
    """Results of a function, found when first asked for.

    When it is full, what it holds becomes the older generation, and what was that is forgotten; results asked for
    again come back from there.  So the frequent ones stay, and at most twice ``most`` are held.
    """

    def __init__(self, find, most: int) -> None:
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
            if isinstance(key, str) and len(key) > LONGEST:
                return found
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


#: The vocabulary that a worker read last, by a digest of its file.
LOADED: dict[str, Vocabulary] = {}


def loaded(file: str, digest: str) -> Vocabulary:
    if digest not in LOADED:
        with open(SparkFiles.get(file), encoding="utf-8") as text:
            LOADED.clear()
            LOADED[digest] = Vocabulary(text.read())
    return LOADED[digest]


def shipped(spark: SparkSession, vocabulary: str) -> tuple[str, str]:
    """Sends the file to the executors by a name that holds its digest, as they keep files by name; (name, digest)."""
    with open(vocabulary, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    name = f"vocabulary-{digest}.json"
    if not any(f.rsplit("/", 1)[-1] == name for f in spark.sparkContext.listFiles):
        copy = os.path.join(tempfile.mkdtemp(), name)
        shutil.copyfile(vocabulary, copy)
        spark.sparkContext.addFile(copy)
    return name, digest


def coded(file: str, digest: str):
    fields = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches):
        vocabulary = loaded(file, digest)
        for batch in batches:
            ids = [vocabulary.encode(t or "") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            texts = [vocabulary.decode(i).decode("utf-8", "replace") for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(texts, pa.string())], schema=fields)

    return run


def bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and the text decoded from them, of each row.

    ``vocabulary`` is the path of a byte-level ``tokenizers`` file; Spark sends it to the
    executors.  A NULL or empty text has no ids and decodes to an empty text.  Other columns
    of ``docs`` are not used.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(coded(*shipped(spark, vocabulary)), "doc_id long, ids array<int>, decoded string")
