"""SentencePiece encoding and decoding by suffix-array matching.

New segments of a batch are concatenated and indexed with a suffix array (prefix doubling up to
the longest piece). Every piece of the vocabulary is binary-searched for its range of occurrences,
which gives the edges of all segments' lattices at once; the edges are sorted by position. Merge
models are then relaxed over these edges: in each round every segment joins the pair of
neighbouring symbols whose edge scores best, leftmost first, until no edge joins a pair.
Characters outside the vocabulary fall back to bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import slices, table

SPACE = "▁"
#: Characters of new segments that are indexed at once; segments longer than LONG are joined one by one.
INDEX_CHARS, LONG = 1_200_000, 64
#: Segments whose ids a Python worker remembers, in each of two generations.
CACHE_SEGMENTS = 350_000
_NONE = np.int64(2**62)
_EDGE = 32  # lengths of pieces stay below


class Pieces:
    """The vocabulary of a merge model with byte fallback, as a dummy-prefixed, identity-normalised model has it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = np.zeros(256, np.uint32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.names[i][3:5], 16)] = i
        self.char_ids = {self.names[i]: i for i in plain if len(self.names[i]) == 1}
        longer = [i for i in plain if len(self.names[i]) > 1]
        self.ids = np.array(longer, np.int64)
        self.lengths = np.array([len(self.names[i]) for i in longer], np.int64)
        # equal scores share a rank, so that the place decides between them
        scores = np.array([model.get_score(i) for i in longer])
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        self.longest = int(self.lengths.max())
        if self.longest >= _EDGE:
            raise ValueError(f"pieces of {self.longest} characters; fewer than {_EDGE} are supported")
        codes = np.zeros((len(longer), self.longest), np.uint32)
        for row, i in enumerate(longer):
            codes[row, : len(self.names[i])] = [ord(c) + 1 for c in self.names[i]]
        self.codes = codes
        crossing = any(SPACE in self.names[i].lstrip(SPACE) for i in longer)
        lines = any("\n" in self.names[i] for i in longer)
        # no piece joins what this pattern separates
        whole = "(?s).+" if crossing else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if not lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        self.segments = re.compile(whole).findall
        self.raw = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)]


def suffix_ranks(text: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different keys of each doubling level (1, 2, 4, ... characters), and the final rank of every place."""
    levels, keys, width = [], text.astype(np.int64), 1
    values, ranks = np.unique(keys, return_inverse=True)
    levels.append(values)
    while width < longest:
        after = np.zeros(len(ranks), np.int64)
        after[:-width] = ranks[width:] + 1 if width < len(ranks) else 0
        values, ranks = np.unique(ranks * (len(levels[-1]) + 1) + after, return_inverse=True)
        levels.append(values)
        width *= 2
    return levels, ranks


def piece_ranges(levels: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of final ranks that begin with each piece (rows of ``codes``), by binary search level by level."""

    def search(level: int, at: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks at ``level`` of the characters from ``at`` on; ``left``: how many are left (0: any)."""
        size = len(levels[level])
        if level == 0:
            low = np.searchsorted(levels[0], codes[:, at], "left")
            high = np.searchsorted(levels[0], codes[:, at], "right")
        else:
            half = 1 << (level - 1)
            width = len(levels[level - 1]) + 1
            a, b = search(level - 1, at, np.minimum(left, half))
            c, d = (search(level - 1, at + half, left - half) if at + half < codes.shape[1] else (np.zeros_like(a), np.full_like(a, width)))
            full = left <= half
            # a second half that may be anything spans all ranks after the first half's
            low = np.searchsorted(levels[level], np.where(full, a * width, a * width + c + 1), "left")
            high = np.searchsorted(levels[level], np.where(full, b * width, a * width + d + 1), "left")
            high = np.where(~full & (b <= a), low, high)
        anything = left <= 0
        return np.where(anything, 0, low), np.where(anything, size, np.maximum(low, high))

    return search(len(levels) - 1, 0, lengths)


def find_edges(pieces: Pieces, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces of two characters or more: sorted (place * _EDGE + length), and the piece's row."""
    levels, ranks = suffix_ranks(text, pieces.longest)
    suffixes = np.argsort(ranks, kind="stable")
    low, high = piece_ranges(levels, pieces.codes, pieces.lengths)
    counts = np.bincount(ranks, minlength=len(levels[-1]))
    starts = np.concatenate([[0], np.cumsum(counts)])
    first, last = starts[low], starts[high]
    n = last - first
    row = np.repeat(np.arange(len(n)), n)
    place = suffixes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]]
    keys = place * _EDGE + pieces.lengths[row]
    order = np.argsort(keys)
    return keys[order], row[order]


def encode_segments(pieces: Pieces, segments: list[str]) -> list[bytes]:
    """Ids of each segment as little-endian unsigned 32-bit bytes."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    # codes are code points plus one; zero parts the segments, so that no piece spans two
    ends = np.cumsum(sizes + 1) - 1
    text = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le"), np.uint32) + np.uint32(1)
    text[ends] = 0
    starts = ends - sizes
    edge_keys, edge_rows = find_edges(pieces, text)

    def edges(place: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The pieces' rows, -1 where there is none."""
        if not len(edge_keys):
            return np.full(len(place), -1)
        wanted = place * _EDGE + length
        at = np.minimum(np.searchsorted(edge_keys, wanted), len(edge_keys) - 1)
        return np.where((length < _EDGE) & (edge_keys[at] == wanted), edge_rows[at], -1)

    n = len(text)
    place = np.arange(n)
    length = np.ones(n, np.int64)
    alive = text != 0
    after = place + 1
    before = place - 1
    joined = np.full(n, -1)  # the piece of the symbol that starts here
    owner = np.repeat(np.arange(len(segments)), sizes + 1)

    def offers(at: np.ndarray) -> np.ndarray:
        """Rank and place of joining the symbols at ``at`` with their next ones."""
        follow = after[at]
        ok = alive[np.minimum(follow, n - 1)] & (follow < n)
        ok &= owner[np.minimum(follow, n - 1)] == owner[at]
        row = np.full(len(at), -1)
        row[ok] = edges(at[ok], length[at[ok]] + length[follow[ok]])
        return np.where(row >= 0, (pieces.ranks[row] << 32) + at, _NONE)

    offer = np.full(n, _NONE)
    offer[alive] = offers(place[alive])
    short = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    while len(short):
        spans = np.stack([starts[short], ends[short]], 1).ravel()
        best = np.minimum.reduceat(offer, spans)[::2]
        going = best < _NONE
        short = short[going]
        at = best[going] & 0xFFFFFFFF
        _join(at, after, before, length, alive, offer, joined, edges)
        offer[at] = offers(at)
        left = before[at]
        inside = (left >= 0) & (owner[np.maximum(left, 0)] == owner[at])
        left = left[inside]
        left = left[alive[left]]
        offer[left] = offers(left)
    for i in np.flatnonzero(sizes > LONG):
        heap = [int(x) for x in offer[starts[i] : ends[i]] if x < _NONE]
        heapq.heapify(heap)
        while heap:
            value = heapq.heappop(heap)
            p = value & 0xFFFFFFFF
            if not alive[p] or offer[p] != value:
                continue
            one = np.array([p])
            _join(one, after, before, length, alive, offer, joined, edges)
            touched = [p] + ([before[p]] if before[p] >= starts[i] else [])
            fresh = offers(np.array(touched))
            offer[touched] = fresh
            for x in fresh:
                if x < _NONE:
                    heapq.heappush(heap, int(x))
    kept = np.flatnonzero(alive)
    ids = np.where(joined[kept] >= 0, pieces.ids[joined[kept]], -1)
    for code in np.unique(text[kept[ids < 0]]):
        ids[(ids < 0) & (text[kept] == code)] = pieces.char_ids.get(chr(code - 1), -int(code))
    counts = np.ones(len(kept), np.int64)
    odd = np.flatnonzero(ids < 0)
    fallback = [pieces.byte_ids[list(chr(-int(ids[o]) - 1).encode())] for o in odd]
    counts[odd] = [len(f) for f in fallback]
    out = np.repeat(np.maximum(ids, 0), counts).astype("<u4")
    firsts = np.cumsum(counts) - counts
    for o, f in zip(odd, fallback, strict=True):
        out[firsts[o] : firsts[o] + len(f)] = f
    stops = np.cumsum(np.bincount(owner[kept], counts, len(segments)).astype(np.int64)) * 4
    flat = out.tobytes()
    return [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _join(at, after, before, length, alive, offer, joined, edges) -> None:
    """Join the symbols at ``at``, all in different segments, with their next ones."""
    gone = after[at]
    length[at] += length[gone]
    joined[at] = edges(at, length[at])
    alive[gone] = False
    offer[gone] = _NONE
    after[at] = after[gone]
    inner = after[at] < len(before)
    before[after[at][inner]] = at[inner]


class Codec:
    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; none for null and empty texts."""
        split = [self.pieces.segments((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        out, group, wanted, chars = [], [], {}, 0
        for segments in split:
            for s in set(segments).difference(self.known):
                if s in self.older:
                    self.known[s] = self.older[s]
                elif s not in wanted:
                    wanted[s] = None
                    chars += len(s) + 1
            group.append(segments)
            if chars > INDEX_CHARS:
                out += self._finish(group, wanted)
                group, wanted, chars = [], {}, 0
        return out + self._finish(group, wanted)

    def _finish(self, group: list[list[str]], wanted: dict[str, None]) -> list[bytes]:
        if wanted:
            new = list(wanted)
            self.known.update(zip(new, encode_segments(self.pieces, new), strict=True))
        get = self.known.__getitem__
        out = [b"".join(map(get, segments)) for segments in group]
        if len(self.known) > CACHE_SEGMENTS:
            self.older, self.known = self.known, {}
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes of all pieces, without the space that encoding puts first."""
        raw = b"".join(map(self.pieces.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


@cache
def codec_at(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids): the ids as array<int>; empty for null and empty texts. Ids may be null or repeated;
    other columns are not read."""
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                coded = codec_at(model).encode(batch.column(text).to_pylist())
                flat = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])])
                yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], [id_column, "ids"])

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key}, ids array<int>")


def decode(coded: DataFrame, model: str, id_column: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text): the text of each row's ids; empty for null and empty ids."""
    key = coded.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [codec_at(model).decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_column), pa.array(found, pa.string())], [id_column, "text"])

    return coded.select(id_column, ids).mapInArrow(run, f"`{id_column}` {key}, text string")


def round_trip(docs: DataFrame, model: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, n_chars, decoded_same): encodes and decodes every text in one pass.
    decoded_same compares with the text itself, in which the model cannot tell U+2581 from a space."""
    key = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                texts = batch.column(text).to_pylist()
                codec = codec_at(model)
                coded = codec.encode(texts)
                same = [codec.decode(c) == (t or "").replace(SPACE, " ") for c, t in zip(coded, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(id_column), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(zlib.crc32, coded), pa.int64()),
                        pa.array([len(t or "") for t in texts], pa.int64()), pa.array(same),
                    ],
                    [id_column, "n_tokens", "ids_crc32", "n_chars", "decoded_same"],
                )

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key}, n_tokens bigint, ids_crc32 bigint, n_chars bigint, decoded_same boolean")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), piece_model())


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict = {}
