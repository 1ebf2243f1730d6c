"""Byte-level BPE by monoid tree reduction, and decoding back.

A token sequence is the BPE encoding of its bytes exactly if each two neighbours are compatible: the encoding of
their joint bytes is these two tokens. So encodings form a monoid. A piece is halved, in blocks of a power of two, down to single bytes; two
neighbouring encodings are joined by encoding a window around the seam afresh. If the tokens at both window edges
are compatible with those outside, nothing outside can change; else the window grows by one token at that edge.
Encodings of halves and of windows are kept in bounded tables, so common word parts are encoded once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from weftgraph.llm.shared import slices

#: Entries after which a table of known encodings starts anew, about 200 bytes each; bounds a worker's memory, never the result.
KEPT = 600_000
_NONE, _UNKNOWN = 1 << 60, object()
_ENDS = frozenset(".,;:!?")
#: Letters and numbers, first and last, that Unicode added after version 16. The library, whose tables are of
#: that version, takes them for signs; `regex` has newer tables.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBPE:
    """Encodes one text as the rank file and pattern say, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, kept: int = KEPT):
        self.ranks, self.kept = ranks, kept
        self.matches = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[bytes, list[int]] = {}
        self.seams: dict[tuple[int, int], list[int]] = {}
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.ends = {c: str(ranks[c.encode()]) for c in _ENDS}
        self.said = {str(i): b for i, b in self.bytes_of.items()}

    def split(self, text: str) -> list[str]:
        """The pattern's matches, by the classes of the library's version of Unicode."""
        if text.isascii() or not _NEWER.search(text):
            return self.matches.findall(text)
        # A sign for private use stands for what that version doesn't know, as long as matches are sought.
        return [text[m.start() : m.end()] for m in self.matches.finditer(_NEWER.sub("\U0010FFFD", text))]

    def merged(self, data: bytes) -> list[int]:
        """BPE of some bytes by its definition: merge the leftmost pair of least rank until none is left."""
        if len(data) > 64:
            return self._merged_long(data)
        parts, rank = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        pairs = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == _NONE:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows that a repetitive text makes long."""
        n, rank = len(data), self.ranks.get
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(data[i : i + 2], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != length:
                continue  # one of the two has been merged since
            parts[i] += parts[j]
            parts[j], after[i] = None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (r := rank(both := parts[left] + parts[after[left]], _NONE)) != _NONE:
                    heapq.heappush(heap, (r, left, len(both)))
        return [self.ranks[p] for p in parts if p is not None]

    def seam(self, a: int, b: int) -> list[int] | None:
        """The encoding of two tokens' joint bytes; None if it is these two, so that they are compatible."""
        known = self.seams.get((a, b), _UNKNOWN)
        if known is _UNKNOWN:
            if len(self.seams) >= self.kept:
                self.seams.clear()
            known = self.merged(self.bytes_of[a] + self.bytes_of[b])
            known = self.seams[a, b] = None if known == [a, b] else known
        return known

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """The encoding of what x and y encode, end to end."""
        if not x or not y:
            return x + y
        window = self.seam(x[-1], y[0])
        if window is None:
            return x + y
        i, j, text = len(x) - 1, 1, self.bytes_of
        while True:
            left = i == 0 or self.seam(x[i - 1], window[0]) is None
            right = j == len(y) or self.seam(window[-1], y[j]) is None
            if left and right:
                return x[:i] + window + y[j:]
            # Doubling the window keeps the work in proportion to the part that changes.
            step = i and max(1, len(x) - i)
            i -= 0 if left else min(i, step)
            j += 0 if right else min(len(y) - j, j)
            data = b"".join(map(text.__getitem__, x[i:] + y[:j]))
            window = self.halves.get(data)
            if window is None:
                window = self.merged(data)
                if len(data) <= 12:
                    self._keep(data, window)

    def tree(self, data: bytes) -> list[int]:
        if len(data) == 1:
            return [self.ranks[data]]
        known = self.halves.get(data)
        if known is None:
            middle = 1 << (len(data) - 1).bit_length() - 1  # the same blocks for all that begins alike
            known = self.join(self.tree(data[:middle]), self.tree(data[middle:]))
            if len(data) <= 8:
                self._keep(data, known)
        return known

    def _keep(self, data: bytes, ids: list[int]) -> None:
        if len(self.halves) >= self.kept:
            self.halves.clear()
        self.halves[data] = ids

    def piece(self, text: str) -> list[int]:
        """A match of the pattern: its own token if there is one, else by the tree."""
        data = text.encode()
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    def encode(self, text: str) -> list[int]:
        return [i for p in self.split(text) for i in self.piece(p)]

    def _said(self, text: str) -> str:
        return ",".join([str(i) for p in self.split(text) for i in self.piece(p)])

    def _word(self, word: str) -> str:
        """What a space and then this part, which holds no space, encode to."""
        if word.isalpha():
            said = self.old.get(word)
            if said is None:
                said = ",".join(map(str, self.piece(" " + word)))
            if len(word) <= 64:
                if len(self.known) >= self.kept:
                    self.old, self.known = self.known, {}
                self.known[word] = said
            return said
        if word[-1:] in _ENDS and word[:-1].isalpha():
            # Letters and one sign are two matches of the pattern, whatever follows.
            return (self.known.get(word[:-1]) or self._word(word[:-1])) + "," + self.ends[word[-1]]
        return self._said(" " + word)

    def encode_said(self, text: str) -> str:
        """encode() as decimal ids joined by commas, for a pattern that takes letters with at most one leading space.

        Without two spaces in a row, no match begins before a space and ends behind it, other than at its own leading
        space. So the text falls into parts at its spaces; words of letters that were met lately are known.
        """
        if not text:
            return ""
        if "  " in text:
            return self._said(text)
        first, *rest = text.split(" ")
        met, new = self.known.get, self._word
        said = ",".join([met(part) or new(part) for part in rest])
        return ",".join(x for x in (self._said(first) if first else "", said) if x)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_said(self, said: str) -> bytes:
        return b"".join(map(self.said.__getitem__, said.split(","))) if said else b""


_coders: dict[tuple[str, str, int], TreeBPE] = {}


def coder(path: str, pattern: str, kept: int = KEPT) -> TreeBPE:
    """One coder for each vocabulary and worker."""
    if (path, pattern, kept) not in _coders:
        _coders[path, pattern, kept] = TreeBPE(read_ranks(path), pattern, kept)
    return _coders[path, pattern, kept]


_libraries: dict[tuple[str, str], tiktoken.Encoding] = {}


def library(path: str, pattern: str) -> tiktoken.Encoding:
    """The library's coder, one for each vocabulary and worker: for operators that need ids but not how they are made."""
    if (path, pattern) not in _libraries:
        _libraries[path, pattern] = tiktoken.Encoding("of a file", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _libraries[path, pattern]


def _over_texts(path: str, pattern: str, row: Callable, kept: int = KEPT) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern, kept)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column(0)
                made = zip(*(row(bpe, t or "") for t in part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(made, row.kinds, strict=True))], names=["doc_id", *row.names])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text; a null or empty text has none. Repeated rows stay repeated."""

    def row(bpe: TreeBPE, text: str):
        return (bpe.encode(text),)

    row.names, row.kinds = ["ids"], [pa.list_(pa.int32())]
    return docs.select("doc_id", "text").mapInArrow(_over_texts(path, pattern, row), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids count as none."""

    def run(batches):
        bpe = coder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, data binary")


def code_digests(docs: DataFrame, path: str, pattern: str, kept: int = KEPT) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and then decoded from its ids.

    Null and empty texts have 0 tokens and the digests of nothing; rows of equal ids stay apart; other columns are not read.
    kept: entries of a worker's tables of known encodings; fewer take less memory and more time.
    """

    def row(bpe: TreeBPE, text: str):
        said = bpe.encode_said(text)
        return said.count(",") + 1 if said else 0, hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(bpe.decode_said(said)).hexdigest()

    row.names, row.kinds = ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(_over_texts(path, pattern, row, kept), schema)
