"""Byte-pair encoding with forced boundaries, and decoding.

Byte pairs that stand side by side inside no vocabulary token can never be merged
across. A pre-token is cut there, its fragments are merged independently, and their
ids are concatenated. The vocabulary file is a parameter; it is read once per
Python worker and shipped as bytes with the task, so its path need only exist where
the driver runs.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import full_text

CACHE = 300_000  # pre-tokens remembered in a Python worker; a bound on memory, not on the input
LONGEST = 64  # characters of a remembered pre-token
# Texts of these characters alone have one normal form and simple letter classes.
SIMPLE = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it can be printed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """Encoder and decoder for a tokenizer file: byte-level BPE, with or without a word end."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        data = json.loads(spec)
        model = data["model"]
        self.library = Tokenizer.from_str(spec)  # for normal forms and pre-tokens of unusual texts
        self.lower = any(n["type"] == "Lowercase" for n in data["normalizer"]["normalizers"])
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        # The file's pattern, its letter and number classes written out for SIMPLE texts in lower case.
        self.simple = re.compile(
            pattern.replace("[\\p{L}]", "[a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\u017f]")
            .replace("[\\p{N}]", "[0-9\\xb2\\xb3\\xb9\\xbc-\\xbe]")
            .replace("\\p{L}", "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\u017f").replace("\\p{N}", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"))
        within: set[str] = set()
        for token in self.vocab:
            plain = token.removesuffix(self.end)
            within.update(map(str.__add__, plain, plain[1:]))
        self.within = within
        self.special_ids = {t: array("I", [i]).tobytes() for t, i in self.special.items()}
        self.known: dict[str, bytes] = dict(self.special_ids)

    def cut(self, letters: str) -> list[str]:
        """Fragments of a pre-token at its forced boundaries."""
        pairs = list(map(str.__add__, letters, letters[1:]))
        if self.within.issuperset(pairs):
            return [letters]
        ends = [i for i, p in enumerate(pairs, 1) if p not in self.within]
        return [letters[i:j] for i, j in zip([0, *ends], [*ends, len(letters)])]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges of one fragment, lowest rank first, leftmost first."""
        if len(symbols) > 100:
            return self._merge_long(symbols)
        get, never = self.ranks.get, len(self.ranks)
        ranks = [get(p, never) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            i = ranks.index(best)
            joined = symbols[i] + symbols[i + 1]
            symbols[i: i + 2] = [joined]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get((joined, symbols[i + 1]), never)
            if i:
                ranks[i - 1] = get((symbols[i - 1], joined), never)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap, for fragments of any length."""
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n:
                    r = ranks.get((symbols[left], symbols[right]))
                    if r is not None:
                        heapq.heappush(heap, (r, left, symbols[left], symbols[right]))
        return [s for s in symbols if s]

    def pre_token(self, letters: str) -> list[int]:
        """Ids of one pre-token, given as byte letters."""
        fragments = self.cut(letters)
        ids: list[int] = []
        for k, fragment in enumerate(fragments, 1):
            symbols = list(fragment)
            if k == len(fragments):
                symbols[-1] += self.end
            ids += map(self.vocab.__getitem__, self.merge(symbols))
        return ids

    def _letters(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(self.letters.__getitem__, piece.encode()))

    def _pieces(self, text: str) -> list[str]:
        """Pre-tokens; control strings stand alone, as the library has it by default."""
        pieces: list[str] = []
        for part in self.parts.split(text) if any(t in text for t in self.special) else (text,):
            if part in self.special:
                pieces.append(part)
            elif SIMPLE.search(part) is None:
                pieces += self.simple.findall(part.lower() if self.lower else part)
            else:
                for word in _runs(part):
                    normal = self.library.normalizer.normalize_str(word)
                    for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                        pieces.append(bytes(map(self.bytes.__getitem__, p)).decode())
        return pieces

    def pack(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit little-endian numbers.

        Pre-tokens are remembered, up to a bound on memory; their ids don't depend on
        what stands around them.
        """
        if len(self.known) >= CACHE:
            self.known = dict(self.special_ids)
        split = [self._pieces(t) for t in texts]
        new = set().union(*split).difference(self.known)
        for piece in new:
            self.known[piece] = array("I", self.pre_token(self._letters(piece))).tobytes()
        known = self.known.__getitem__
        packed = [b"".join(map(known, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > LONGEST:
                del self.known[piece]
        return packed

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack([text])[0], "<u4").tolist()

    def decode(self, ids: Sequence[int]) -> str:
        """Tokens side by side, one space between; the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _runs(text: str) -> list[str]:
    """Runs without white space, where \\x1c to \\x1f are no white space."""
    return re.findall("(?:[^\\s]|[\\x1c-\\x1f])+", text)


class LibraryBpe(Bpe):
    """The same ids, the merges of unseen pieces left to the library; only encodes, and holds nothing else."""

    def __init__(self, spec: str):
        super().__init__(spec)
        self.ranks, self.tokens, self.within, self.vocab = {}, {}, set(), {}

    def forget(self) -> None:
        """Drops the remembered pre-tokens; a Python worker outlives the task."""
        self.known = dict(self.special_ids)

    def pre_token(self, letters: str) -> list[int]:
        return [t.id for t in self.library.model.tokenize(letters)]


@lru_cache(maxsize=2)
def load(spec: str, kind: type[Bpe] = Bpe) -> Bpe:
    """One encoder per vocabulary in a Python worker, kept from task to task."""
    return kind(spec)


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and decoded text of every row.

    Null and empty texts have no ids and decode to nothing. Texts of any length are
    encoded whole. Rows keep their partition; no shuffle.
    """
    rows = docs.select(docs[id_col].alias("id"), full_text(docs[text_col]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                ids = [np.frombuffer(x, "<i4") for x in bpe.pack(part.column(1).to_pylist())]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(ends, np.concatenate(ids))
                decoded = pa.array([bpe.decode(i.tolist()) for i in ids], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lists, decoded], ["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
