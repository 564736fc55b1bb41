"""Cross-tokenizer alignment by white-space token anchors.

Both tokenizers encode whole texts. Byte offsets at which tokens of both end are shared ends; those
before tokens that start with a space in both are anchors, which split a document into windows of
token ids. A window's alignment (its groups between shared ends, its links between overlapping
tokens) depends on its two id tuples only and is memoised by them. Links are counted over the corpus
by pairs of ids: each chunk of documents sends its different pairs once, and gets their counts back.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, slices, table

SPACE = "▁"
#: A chunk ends after so many characters or different windows; memory of a task follows these.
CHUNK_CHARS, CHUNK_WINDOWS = 12_000_000, 250_000
#: Characters that are encoded at once.
SLICE_CHARS = 1_000_000


class ByteTokenizer:
    """A byte-level BPE vocabulary file of the tokenizers library, merged by rank. Special tokens' strings are plain text."""

    #: Fixed value: how byte-level vocabularies cut a text before merging.
    PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocabulary[a + b] for a, b in merges]
        if sorted(made) != made:
            raise ValueError("ids do not follow the order of merges")
        of = {letter: b for b, letter in self.letters().items()}
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            if all(c in of for c in name):
                self.raw[i] = bytes(of[c] for c in name)
        known = {*made, *(vocabulary[c] for c in of if c in vocabulary)}
        self.encoding = tiktoken.Encoding("own", pat_str=self.PATTERN, mergeable_ranks={self.raw[i]: i for i in known}, special_tokens={})

    @staticmethod
    def letters() -> dict[int, str]:
        """How each byte is spelt: printable ones as themselves, the others in order from code point 256 on."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encoding.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]


class PieceTokenizer:
    """A SentencePiece model file; it adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.raw = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode(texts, num_threads=1)]


@cache
def tokenizer_at(path: str) -> ByteTokenizer | PieceTokenizer:
    """One a Python worker, by the file's kind."""
    return PieceTokenizer(path) if path.endswith(".model") else ByteTokenizer(path)


@cache
def looks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Of every id: its bytes' number, and whether they start with a space."""
    raw = tokenizer_at(path).raw
    return np.array([len(x) for x in raw], np.int64), np.array([x[:1] == b" " for x in raw])


class Windows(dict):
    """Numbers the different windows of a chunk by their id tuples (a window's ids as bytes, those of B
    with the highest bit set) and keeps each one's alignment."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.coders, self.looks = (tokenizer_at(path_a), tokenizer_at(path_b)), (looks(path_a), looks(path_b))
        self.spelt: list[str] = []
        self.raw: list[bytes | None] = []  # the bytes that both tokenizers give; None if they differ
        self.groups: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []  # A id << 32 | B id

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number

    def align(self, numbers: np.ndarray, ids: tuple[np.ndarray, np.ndarray], starts: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray]) -> None:
        """Align the windows that are new among ``numbers``; these span ``starts`` to ``ends`` in the ids.

        Laid end to end, a link stands for each place at which a token of either side ends, and a group
        for each at which tokens of both do."""
        found, first = np.unique(numbers, return_index=True)
        first = first[found >= len(self.spelt)]
        if not len(first):
            return
        own, at, upto = [], [], []
        for k in (0, 1):
            lengths = ends[k][first] - starts[k][first]
            upto.append(np.cumsum(lengths))
            own.append(ids[k][np.repeat(starts[k][first] - upto[k] + lengths, lengths) + np.arange(upto[k][-1])])
            at.append(np.cumsum(self.looks[k][0][own[k]]))
        marks = np.zeros((2, at[0][-1] + 1), bool)
        for k in (0, 1):
            marks[k, at[k]] = True
        places = np.flatnonzero(marks[0] | marks[1])
        token = [np.searchsorted(at[k], places) for k in (0, 1)]
        self.links.append(own[0][token[0]].astype(np.int64) << 32 | own[1][token[1]])
        last = np.searchsorted(places, at[0][upto[0] - 1])  # each window's last link
        self.sizes.append(np.diff(last, prepend=-1))
        shared = marks[0, places] & marks[1, places]
        groups = np.cumsum(shared)[last]
        self.groups += np.diff(groups, prepend=0).tolist()
        spelt: list[str] = []
        names = [list(map(str, own[k].tolist())) for k in (0, 1)]
        cuts = [[0, *(token[k][shared] + 1).tolist()] for k in (0, 1)]
        for i, j, p, q in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]):  # noqa: B905
            spelt.append(f"{names[0][i]}|{names[1][p]}" if j - i == 1 == q - p else ",".join(names[0][i:j]) + "|" + ",".join(names[1][p:q]))
        g = 0
        for e in groups.tolist():
            self.spelt.append(";".join(spelt[g:e]))
            g = e
        raw = [list(map(self.coders[k].raw.__getitem__, own[k].tolist())) for k in (0, 1)]
        i = p = 0
        for j, q in zip(upto[0].tolist(), upto[1].tolist(), strict=True):
            one = b"".join(raw[0][i:j])
            self.raw.append(one if one == b"".join(raw[1][p:q]) else None)
            i, p = j, q

    def table(self, used: np.ndarray) -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray]:
        """Windows' numbers of links, and their links as numbers of different pairs; the pairs' A and B
        ids and how many links have them, with ``used`` times of each window."""
        sizes = np.concatenate([*self.sizes, np.empty(0, np.int64)])
        codes, links = np.unique(np.concatenate([*self.links, np.empty(0, np.int64)]), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, links, np.repeat(used, sizes))
        return sizes.astype("<u4").tobytes(), links.astype("<u4").tobytes(), (codes >> 32).astype(np.int32), (codes & 0xFFFFFFFF).astype(np.int32), n


def window_bounds(ids_a: np.ndarray, ids_b: np.ndarray, of_a, of_b, last_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token positions (in A, in B) at which windows end, over texts laid end to end; ``last_a`` are
    the positions in A at which texts end. Both tokenisations cover the same bytes."""
    ends_a, ends_b = np.cumsum(of_a[0][ids_a]), np.cumsum(of_b[0][ids_b])
    closes = np.zeros(len(ids_a) + 1, bool)
    closes[last_a] = True
    spaced = np.append(of_a[1][ids_a], False)[1:]
    shared = np.zeros(ends_a[-1] + 1, bool)
    shared[ends_b] = True
    at_a = np.flatnonzero((spaced | closes[1:]) & shared[ends_a])
    at_b = np.searchsorted(ends_b, ends_a[at_a])
    stay = closes[at_a + 1] | np.append(of_b[1][ids_b], False)[at_b + 1]
    return at_a[stay] + 1, at_b[stay] + 1


def coded_rows(docs: DataFrame, path_a: str, path_b: str, id_column: str, text: str, keep_groups: bool) -> DataFrame:
    """One row per document, with its windows' numbers within its chunk, and one row per chunk
    (``sizes`` is not null) with the windows' links and the chunk's counts of different id pairs."""
    key = docs.schema[id_column].dataType.simpleString()
    plain = "_chunk bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, windows binary"
    schema = f"`{id_column}` {key}, {plain}, sizes binary, links binary, a array<int>, b array<int>, n array<bigint>"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coders = tokenizer_at(path_a), tokenizer_at(path_b)
        of_a, of_b = looks(path_a), looks(path_b)
        chunk, names = TaskContext.get().partitionId() << 32, [x.split()[0].strip("`") for x in schema.split(", ")]
        memo, chars, times = Windows(path_a, path_b), 0, []
        kinds: list = []

        def rows(ids, columns):
            made = [ids, *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))]
            return pa.RecordBatch.from_arrays(made, names)

        def close():
            used = np.zeros(len(memo), np.int64)
            for seen in times:
                used[: len(seen)] += seen
            sizes, links, *pairs = memo.table(used)
            return rows(pa.nulls(1, kinds[0]), [[chunk], *[[None]] * 7, [sizes], [links], *([x] for x in pairs)])

        for whole in batches:
            kinds = [whole.schema.field(id_column).type, *[pa.int64()] * 5, pa.string(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            for batch in slices(whole, text, SLICE_CHARS):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                coded = [coder.encode(texts) for coder in coders]
                sizes = [[int(of[0][x].sum()) for x in ids] for of, ids in zip((of_a, of_b), coded, strict=True)]
                fits = [k for k, t in enumerate(texts) if t and sizes[0][k] == sizes[1][k] == len(t.encode()) + 1]
                zero = (0, 0, 0, 0, "", "" if keep_groups else None, b"")
                out = [zero] * len(texts)
                if fits:
                    ids_a, ids_b = (np.concatenate([c[k] for k in fits]) for c in coded)
                    last_a = np.cumsum([len(coded[0][k]) for k in fits])
                    upto_a, upto_b = window_bounds(ids_a, ids_b, of_a, of_b, last_a)
                    from_a, from_b = np.append(0, upto_a[:-1]), np.append(0, upto_b[:-1])
                    bytes_a, bytes_b = ids_a.tobytes(), (ids_b | np.uint32(1 << 31)).tobytes()
                    get = memo.__getitem__
                    spans = zip((4 * from_a).tolist(), (4 * upto_a).tolist(), (4 * from_b).tolist(), (4 * upto_b).tolist(), strict=True)
                    numbers = np.fromiter([get(bytes_a[p:q] + bytes_b[r:s]) for p, q, r, s in spans], np.int64, len(upto_a))
                    memo.align(numbers, (ids_a, ids_b), (from_a, from_b), (upto_a, upto_b))
                    groups, start, counted = np.array(memo.groups, np.int64), 0, []
                    for k, end in zip(fits, (np.searchsorted(upto_a, last_a) + 1).tolist(), strict=True):
                        own = numbers[start:end]
                        start, listed = end, own.tolist()
                        raw = list(map(memo.raw.__getitem__, listed))
                        if None in raw or b"".join(raw) != b" " + texts[k].encode():
                            continue
                        counted.append(own)
                        spelt = ";".join(map(memo.spelt.__getitem__, listed))
                        n_a, n_b, n_groups = len(coded[0][k]), len(coded[1][k]), int(groups[own].sum())
                        digest = hashlib.sha256(spelt.encode()).hexdigest()
                        # a group of p and q tokens without a shared end inside has p + q - 1 links
                        out[k] = (n_a, n_b, n_groups, n_a + n_b - n_groups, digest, spelt if keep_groups else None, own.astype("<u4").tobytes())
                    times += [np.bincount(np.concatenate(counted))] if counted else []
                yield rows(batch.column(id_column), [[chunk] * len(out), *zip(*out, strict=True), *[[None] * len(out)] * 5])
                chars += sum(map(len, texts))
                if chars > CHUNK_CHARS or len(memo) > CHUNK_WINDOWS:
                    yield close()
                    chunk, memo, chars, times = chunk + 1, Windows(path_a, path_b), 0, []
        if kinds and chars:
            yield close()

    return docs.select(id_column, text).mapInArrow(run, schema)


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every document, and with
    ``keep_groups`` the ``groups`` themselves (``a1,a2|b1;a3|b2``).

    A link joins tokens of A and B whose byte ranges overlap; a pair's count is the number of links in
    the whole corpus that join these ids. n_best counts a document's links whose count is the highest
    that their B id has anywhere, ties included; count_sum adds up its links' counts.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte (after one
    space), have no tokens: zeros and empty strings. Repeated rows and ids keep their rows, and their
    links count as often. Texts of any length are encoded whole. Null ids keep their rows. Other
    columns are not read. An empty table gives an empty result.

    A pair of ids comes once from each chunk of documents, so the most frequent pair is at most a row a
    chunk; a B id has at most as many pairs as A has ids. What meets by chunk is bounded by CHUNK_CHARS.
    """
    key = docs.schema[id_column].dataType.simpleString()
    coded = cut(coded_rows(docs, path_a, path_b, id_column, text, keep_groups), "alignments")
    sent = coded.where("sizes is not null").select("_chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("i", "p")).select("_chunk", "i", "p.*")
    totals = sent.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("best"))
    counted = sent.select(F.col("_chunk").alias("_of"), "i", "a", "b").join(known, ["a", "b"]).select("_of", "i", "total", "best")
    result = f"`{id_column}` {key}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string" + ", groups string" * keep_groups

    def meet(left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        about = left.filter(pc.is_valid(left["sizes"]))
        rows = left.filter(pc.is_null(left["sizes"]))
        sums = np.zeros((2, 0), np.int64)
        if len(about) and len(right):
            by_pair = np.zeros((2, len(right)), np.int64)
            at = right["i"].to_numpy()
            by_pair[0, at], by_pair[1, at] = right["best"].to_numpy(), right["total"].to_numpy()
            sizes, links = (np.frombuffer(about[c][0].as_py(), "<u4").astype(np.int64) for c in ("sizes", "links"))
            sums = np.add.reduceat(by_pair[:, links], np.cumsum(sizes) - sizes, axis=1)
        found = [sums[:, np.frombuffer(w, "<u4")].sum(1) for w in rows["windows"].to_pylist()]
        best, counts = np.array(found, np.int64).reshape(-1, 2).T
        names = [id_column, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups]
        return pa.table([pa.array(best) if c == "n_best" else pa.array(counts) if c == "count_sum" else rows[c] for c in names], names)

    rows = coded.select("_chunk", id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * keep_groups, "windows", "sizes", "links")
    return rows.groupBy("_chunk").cogroup(counted.groupBy("_of")).applyInArrow(meet, result)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLES: dict = {}
