"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text's encoding is the reduction of a binary tree: its halves are encoded, down
to leaves of a few words, and two neighbours are joined by re-encoding a window
round their boundary, which grows until the tokens outside provably stand.

*Across matches of the split pattern* a window ends at sync points: places where
the kind of character (letter, number, space, other) changes, but for a space or
an apostrophe before another character.  No match of PATTERN holds two characters
with such a place between them, so every encoding of any text that holds both has
a match boundary there, and what it makes of either side doesn't depend on the
other.  Tokens outside of two sync points are final.

*Inside one match* there are no such points.  A stretch of more than LONG code
points without any (a run of spaces, of letters, ...) is cut out of its text at
its sync points, split into matches by rule, and each match is the reduction of
a tree of its own: a window of tokens round the boundary is merged again, and
stands as soon as each token next to it keeps apart from the window's token
beside it, if these two alone are encoded.  Merges within a token come in the
same order whatever surrounds it, so neighbours that keep apart in pairs keep
apart in the whole.  The window grows, or moves on to where two tokens don't
keep apart, so neither the library's regular expression nor a merge ever takes
in a long run at once.

Decoding concatenates the leaves' bytes up a tree of the same kind.

Null texts count as empty; an empty text has no tokens.  Rows are independent:
repeated rows and ties change nothing, further columns are ignored.  A worker
holds one slice of a batch and, within it, one text's tokens at a time.  Ranks
are those of a trained vocabulary, in which every token is what its own bytes
merge to.  The pattern is fixed, since the sync points follow from it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfield.llm import _text

#: Code points of a leaf of a text's tree, bytes of a leaf of a match's tree, tokens of a leaf in decoding.
LEAF, PIECE_LEAF, DECODED_LEAF = 64, 256, 64
#: Code points without a sync point from which on a stretch has a tree of its own.
LONG = 1024
#: Bytes of text whose tokens a worker holds as Python numbers at once.
SLICE_BYTES = 1 << 20

# The pattern that splits texts before merges, and the contractions it names.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tiktoken encoding of a rank file, kept by worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(f"ranks:{path}", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> dict[int, bytes]:
    bpe = tokenizer(path)
    return {bpe.encode_single_token(b): b for b in bpe.token_byte_values()}


@functools.lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point, as the library's own regular expressions see it."""
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sync_points(text: str) -> np.ndarray:
    """Places i at which text[:i] and text[i:] are encoded apart, whatever surrounds the two characters."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    kind = kinds()[code]
    before, after = kind[:-1], kind[1:]
    return np.flatnonzero((before != after) & (before != _SPACE) & ~((code[:-1] == ord("'")) & (after == _LETTER))) + 1


def matches(stretch: str) -> list[str]:
    """The matches of the pattern in a stretch without sync points: spaces, then one run (or apostrophes and letters)."""
    kind = kinds()[np.frombuffer(stretch.encode("utf-32-le"), dtype=np.uint32)]
    n, spaces = len(kind), int(np.argmax(kind != _SPACE)) if (kind != _SPACE).any() else len(kind)
    if spaces == n:
        return [stretch]
    out, at = [], spaces
    if spaces > 1:
        out.append(stretch[: spaces - 1])
    if spaces and stretch[spaces - 1] == " ":
        at -= 1
    elif spaces:
        out.append(stretch[spaces - 1])
    letters = int(np.argmax(kind == _LETTER)) if kind[spaces] == _OTHER and kind[-1] == _LETTER else n
    short = next((c for c in _CONTRACTIONS if stretch.startswith(c, at)), None)
    if short and letters < n:
        letters = at + len(short)
    return [*out, stretch[at:letters], *([stretch[letters:]] if letters < n else [])]


class Codec:
    """Tree encoding of texts by one rank file."""

    def __init__(self, path: str, leaf: int = LEAF, piece_leaf: int = PIECE_LEAF, long: int = LONG) -> None:
        self.bpe, self.leaf, self.piece_leaf, self.long = tokenizer(path), leaf, piece_leaf, long
        self.bytes = token_bytes(path)
        self.merged = self.bpe._encode_single_piece
        self.apart: dict[tuple[int, int], bool] = {}
        #: Joins of neighbours so far, across matches and inside them.
        self.joins = self.piece_joins = 0

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        sync = sync_points(text)
        edges = np.concatenate([[0], sync, [len(text)]])
        far = np.flatnonzero(np.diff(edges) > self.long)
        syncs, out, at = sync.tolist(), [], 0
        for begin, end in zip(edges[far].tolist(), edges[far + 1].tolist(), strict=True):
            out += self._tree(text, at, begin, syncs)
            for match in matches(text[begin:end]):
                out += self._piece(match.encode())
            at = end
        return out + self._tree(text, at, len(text), syncs)

    def _tree(self, text: str, lo: int, hi: int, syncs: list[int]) -> list[int]:
        if hi - lo <= self.leaf:
            return self.bpe.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._tree(text, lo, mid, syncs), self._tree(text, mid, hi, syncs)
        self.joins += 1
        x, y = bisect_right(syncs, mid) - 1, bisect_left(syncs, mid)
        a = max(lo, syncs[x]) if x >= 0 else lo
        b = min(hi, syncs[y]) if y < len(syncs) else hi
        if a == b:
            return left + right
        return self._without(left, text[a:mid], -1) + self.bpe.encode_ordinary(text[a:b]) + self._without(right, text[mid:b], 1)

    def _without(self, ids: list[int], text: str, step: int) -> list[int]:
        """ids without the tokens of `text`, which they begin (step 1) or end (-1) with."""
        left, count = len(text.encode()), 0
        while left > 0:
            left -= len(self.bytes[ids[count if step > 0 else -1 - count]])
            count += 1
        if left:
            raise AssertionError("a sync point isn't a token boundary")
        return ids[count:] if step > 0 else ids[: len(ids) - count]

    def _piece(self, data: bytes) -> list[int]:
        """The tokens of one match."""
        if len(data) <= self.piece_leaf:
            return self.merged(data)
        mid = len(data) // 2
        self.piece_joins += 1
        return self._met(self._piece(data[:mid]), self._piece(data[mid:]))

    def _keep_apart(self, a: int, b: int) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) > 1 << 16:
                self.apart.clear()
            found = self.apart[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def _met(self, left: list[int], right: list[int]) -> list[int]:
        """Two matches' tokens as those of one match."""
        right.reverse()
        least, way = 1, 0
        while left and right and not self._keep_apart(left[-1], right[-1]):
            window, width = [], least
            while True:
                width = min(width, max(len(left), len(right)))
                window = left[-width:] + window + right[: -width - 1 : -1]
                del left[-width:], right[-width:]
                inner = self.merged(b"".join([self.bytes[i] for i in window]))
                on_left = not left or self._keep_apart(left[-1], inner[0])
                on_right = not right or self._keep_apart(inner[-1], right[-1])
                if on_left or on_right:
                    break
                width *= 2
            # what stands on one side joins it; the search goes on at the other
            if on_left:
                left += inner
            else:
                right += reversed(inner)
            turn = 1 if on_left else -1
            if way not in (0, turn):
                least *= 2
            way = turn
        return left + right[::-1]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODED_LEAF:
            return b"".join([self.bytes[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode(df: DataFrame, text: str = "text", *, keep: tuple[str, ...] = ("doc_id",), tokens: bool = True, digests: bool = False, path: str | None = None) -> DataFrame:
    """Rows of `df` with `keep`, n_tokens and, as asked for, the tokens (array<int>) or digests of ids and of the decoded bytes.

    path: the rank file, which every machine has.
    """
    if path is None:
        path = default_path()
    kept = df.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long"
    schema += ", tokens array<int>" if tokens else ""
    schema += ", ids_sha256 string, decoded_sha256 string" if digests else ""
    names = [f.name for f in kept]
    inner = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        decimal = [str(i) for i in range(codec.bpe.max_token_value + 1)]
        for batch in batches:
            for part in _text.slices(batch, "_text", SLICE_BYTES):
                ids = [codec.encode(t or "") for t in part.column("_text").to_pylist()]
                out = [part.column(c) for c in inner] + [pa.array([len(x) for x in ids], pa.int64())]
                if tokens:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                if digests:
                    out.append(pa.array([hashlib.sha256(",".join([decimal[i] for i in x]).encode()).hexdigest() for x in ids]))
                    out.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]))
                yield pa.RecordBatch.from_arrays(out, [*names, "n_tokens", *["tokens"] * tokens, *["ids_sha256", "decoded_sha256"] * digests])

    return df.select(*(df[c].alias(i) for c, i in zip(keep, inner, strict=True)), df[text].cast("string").alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, tokens: str = "tokens", *, keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Rows of `df` with `keep` and `text`, the decoded tokens; null tokens give a null text, bytes that aren't UTF-8 are replaced."""
    if path is None:
        path = default_path()
    kept = df.select(*keep).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", text string"
    names = [f.name for f in kept]
    inner = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in part.column("_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in inner), pa.array(texts, pa.string())], [*names, "text"])

    return df.select(*(df[c].alias(i) for c, i in zip(keep, inner, strict=True)), df[tokens].cast("array<int>").alias("_ids")).mapInArrow(run, schema)
