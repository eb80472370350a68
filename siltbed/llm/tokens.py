"""Token ids of a whole corpus in a public byte-level BPE vocabulary.

Texts up to LEAF characters are encoded where they are read. A longer text is cut into leaves of LEAF characters,
wherever that falls; the leaves are spread over all tasks and encoded in parallel, then concatenated as a tree. A
join re-encodes a window around the seam, twice as wide each time, until it agrees with both sides: its first token
is the left side's token at that place, and its last token the right side's. See join() for why that is exact.

Defined results: null and empty texts have no ids (an empty list, 0 tokens); text that spells a special token is
ordinary text. Rows with the same id stay separate rows.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import balanced, shared_path, ship, written

DIRECTORY = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
LEAF = 32_768
#: Words kept with their ids, and the longest of them, in each Python worker.
KEPT_WORDS, KEPT_LENGTH = 200_000, 24
# Fixed value: the pattern by which this vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[tuple[str, str], Encoder] = {}


class _Words(dict):
    """Ids (as bytes) of a word with a space before it, kept for short words."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<i4").tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, directory: str, vocabulary: str) -> None:
        import tiktoken

        with open(f"{directory}/{vocabulary}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.plain = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.plain)

    # A space between a word and other text starts a new piece of the pattern, so the words may be encoded one by
    # one; not so where the space has white space on both sides, as pieces of white space then reach across it.
    _UNSAFE = re.compile(r"\s \s")

    def raw(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if "  " in text or self._UNSAFE.search(text):
            return np.array(self.plain(text), "<i4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<i4").tobytes() + b"".join(map(self.words.__getitem__, rest))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw(text), "<i4")


def encoder(directory: str = DIRECTORY, vocabulary: str = VOCABULARY) -> Encoder:
    """The encoder, loaded once in a process."""
    at = (directory, vocabulary)
    if at not in _LOADED:
        _LOADED[at] = Encoder(directory, vocabulary)
    return _LOADED[at]


def _kind(c: str) -> str:
    if c.isspace() and not "\x1c" <= c <= "\x1f":  # Python's white space has four separators more than the pattern's
        return "space"
    k = unicodedata.category(c)
    return {"L": "letter", "N": "digit"}.get(k[0], "unknown" if k == "Cn" else "mark")


def _ends_piece(a: str, b: str) -> bool:
    """Whether the pattern splits between a and b whatever surrounds them: at a change of kind, except after white
    space (it may join what follows) and an apostrophe (it may open a contraction)."""
    x, y = _kind(a), _kind(b)
    return x != y and x != "space" and a != "'" and "unknown" not in (x, y)


def _inside(chars: str) -> bool:
    """Whether all chars are of one kind, so that they lie in one run, without an apostrophe."""
    kinds = {_kind(c) for c in chars}
    return len(kinds) == 1 and "unknown" not in kinds and "'" not in chars


def join(enc: Encoder, left: np.ndarray, right: np.ndarray, width: int = 8) -> np.ndarray:
    """The ids of a text from those of its two halves.

    The window starts and ends at token bounds that are character bounds. On the left it is accepted if the text
    starts there, or if the window's first token equals the left half's there and the place is either one where the
    pattern always splits or inside a run of one kind of character; likewise on the right. In a run, all tokens are
    merges of one piece, and a sequence of tokens is the encoding of its piece exactly if each pair of neighbours is
    the encoding of the two together: pairs left of the window come from the left half, pairs right of it from the
    right half, all others from the window, which shares its outer tokens with the halves.
    """
    if not len(left) or not len(right):
        return left if len(left) else right
    table = enc.bytes_of
    starts = lambda t: table[t][0] & 0xC0 != 0x80
    while True:
        i, j = max(0, len(left) - width), min(len(right), width)
        while i > 0 and not starts(left[i]):
            i -= 1
        while j < len(right) and not starts(right[j]):
            j += 1
        text = b"".join(table[t] for t in (*left[i:], *right[:j])).decode()
        seam = np.array(enc.plain(text), "<i4")
        before = b"".join(table[t] for t in left[max(0, i - 8) : i]).decode("utf-8", "ignore")[-1:]
        after = b"".join(table[t] for t in right[j : j + 8]).decode("utf-8", "ignore")[:1]
        on_left = i == 0 or (
            seam[0] == left[i] and bool(before) and (_ends_piece(before, text[0]) or (len(text) > 1 and _inside(before + text[:2])))
        )
        on_right = j == len(right) or (
            seam[-1] == right[j - 1] and bool(after) and (_ends_piece(text[-1], after) or (len(text) > 3 and _inside(text[-4:] + after)))
        )
        if on_left and on_right:
            return np.concatenate([left[:i], seam, right[j:]]).astype("<i4")
        width *= 2


def concatenate(enc: Encoder, parts: list[np.ndarray]) -> np.ndarray:
    """Join neighbours, then the joined neighbours, until one is left."""
    while len(parts) > 1:
        parts = [join(enc, *parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else np.empty(0, "<i4")


def _lists(raw: list[bytes]):
    import pyarrow as pa

    ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int64)
    values = pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32())
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def _chunks(batches: Iterator, text: str, most: int = 4_000_000) -> Iterator:
    """Batches cut so that each holds about most characters of text at most (or one row)."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0))
        at = 0
        while at < len(sizes):
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most, "right")))
            yield b.slice(at, stop - at)
            at = stop


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    directory: str = DIRECTORY,
    vocabulary: str = VOCABULARY,
    leaf: int = LEAF,
    count_only: bool = False,
) -> DataFrame:
    """(id, ids ARRAY<INT>) of each row of docs, or (id, n INT), the number of ids, with count_only."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, " + ("n int" if count_only else "ids array<int>")
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__text"))

    def result(ids, raw: list[bytes]):
        import pyarrow as pa

        last = pa.array(np.array([len(x) // 4 for x in raw], np.int32)) if count_only else _lists(raw)
        return pa.RecordBatch.from_arrays([ids, last], names=[id_col, "n" if count_only else "ids"])

    def whole(batches: Iterator) -> Iterator:
        enc = encoder(directory, vocabulary)
        for b in _chunks(batches, "__text"):
            yield result(b.column("__id"), [enc.raw(t) if t else b"" for t in b.column("__text").to_pylist()])

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at, (r, t) in enumerate(zip(b.column("__row").to_pylist(), b.column("__text").to_pylist(), strict=True)):
                pieces = [t[k : k + leaf] for k in range(0, len(t), leaf)]
                for k in range(0, len(pieces), 64):
                    some = pieces[k : k + 64]
                    ids = b.column("__id").take(pa.array([at] * len(some)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r] * len(some), pa.int64()), ids, pa.array(range(k, k + len(some)), pa.int32()), pa.array(some, pa.string())],
                        names=["__row", "__id", "leaf", "piece"],
                    )

    def leaves(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = encoder(directory, vocabulary)
        for b in _chunks(batches, "piece"):
            ids = _lists([enc.raw(t) for t in b.column("piece").to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("__row", "__id", "leaf")], ids], names=["__row", "__id", "leaf", "ids"])

    def tree(group):
        import pyarrow as pa

        enc = encoder(directory, vocabulary)
        group = group.sort_by("leaf")
        parts = [x.values.to_numpy() for x in group.column("ids")]
        done = concatenate(enc, parts).astype("<i4").tobytes()
        last = pa.array([len(done) // 4], pa.int32()) if count_only else _lists([done])
        return pa.table({id_col: group.column("__id")[:1].combine_chunks(), "n" if count_only else "ids": last})

    short = balanced(base.filter(F.col("__text").isNull() | (F.length("__text") <= leaf))).mapInArrow(whole, out)
    # The leaves are written with the number of their row, which so is given once, and keeps rows of one id apart.
    numbered = base.filter(F.length("__text") > leaf).withColumn("__row", F.monotonically_increasing_id())
    pieces = written(numbered.mapInArrow(cut, f"__row bigint, __id {kind}, leaf int, piece string"), shared_path(docs.sparkSession, "leaves"))
    joined = (
        pieces.repartition("__row", "leaf")
        .mapInArrow(leaves, f"__row bigint, __id {kind}, leaf int, ids array<int>")
        .groupBy("__row")
        .applyInArrow(tree, out)
    )
    return short.unionByName(joined)
