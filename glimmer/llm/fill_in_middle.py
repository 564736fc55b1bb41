"""Fill-in-the-middle transformation on piece tables.

A document becomes a table of descriptors (buffer, start, length) over two buffers that never change:
its text and the sentinels. Cutting a document splits descriptors, an arrangement permutes them and
puts sentinels between, the inverse permutation restores the text, and hashes stream the descriptors'
slices. No text is copied until an output is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
TEXT, MARKS = 0, 1
#: Per cent of the documents that are transformed, and of those the share with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Order of prefix (0), middle (1) and suffix (2) in an output, and the sentinel before each part.
ARRANGEMENTS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}
#: Code points that a hash encodes at once.
STREAM = 1 << 20


@dataclass(frozen=True)
class Piece:
    """A slice of one buffer."""

    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors in order over a text and the sentinels; every method leaves the buffers alone."""

    def __init__(self, text: str, pieces: Iterable[Piece] | None = None) -> None:
        self.buffers = (text, SENTINELS)
        self.pieces = [Piece(TEXT, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, *places: int) -> list[list[Piece]]:
        """The descriptors between ascending ``places`` (code points of the whole table): one list a
        part, one part more than places. A descriptor that a place falls into is split."""
        parts, at, ends = [[]], 0, list(places)
        for piece in self.pieces:
            while ends and ends[0] <= at + piece.length:
                head = ends.pop(0) - at
                if head:
                    parts[-1].append(Piece(piece.buffer, piece.start, head))
                piece = Piece(piece.buffer, piece.start + head, piece.length - head)
                at += head
                parts.append([])
            if piece.length:
                parts[-1].append(piece)
            at += piece.length
        return parts

    def arranged(self, form: str, first: int, second: int) -> PieceTable:
        """Prefix, middle and suffix by cuts at ``first`` and ``second``, permuted as ``form`` has it."""
        parts = self.cut(first, second)
        out: list[Piece] = []
        for part, mark in ARRANGEMENTS[form]:
            out.append(Piece(MARKS, SENTINELS.index(mark), len(mark)))
            out += parts[part]
        return PieceTable(self.buffers[TEXT], out)

    def restored(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: the table of an output is cut at its sentinels, which go, and
        the parts return to their places. No part may hold a sentinel."""
        whole = self.text()
        order = ARRANGEMENTS[form]
        starts, at = [], 0
        for _, mark in order:
            at = whole.index(mark, at)
            starts.append(at)
            at += len(mark)
        parts = self.cut(*[x for start, (_, mark) in zip(starts, order, strict=True) for x in (start, start + len(mark))])
        back = {part: parts[2 * (k + 1)] for k, (part, _) in enumerate(order)}
        return PieceTable(self.buffers[TEXT], [p for part in sorted(back) for p in back[part]])

    def stream(self) -> Iterator[str]:
        for p in self.pieces:
            for start in range(p.start, p.start + p.length, STREAM):
                yield self.buffers[p.buffer][start : min(start + STREAM, p.start + p.length)]

    def text(self) -> str:
        return "".join(self.stream())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part.encode())
        return digest.hexdigest()


def unit_starts(text: str) -> np.ndarray:
    """Code points at which a unit starts: a run of A-Z and a-z, or any other single character."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = ((codes | 32) - 97 < 26) & (codes < 128)
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside)


def draws(key: object, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers out of the SHA-256 of ``seed:key``."""
    found = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(found[8 * k : 8 * k + 8], 16) for k in range(4)]


@dataclass(frozen=True)
class Transformed:
    n: int
    form: str
    first: int | None
    second: int | None
    output: PieceTable


def transform(text: str | None, key: object, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> Transformed:
    """One document's table in its form; ``first`` and ``second`` are the cuts in code points (None if plain)."""
    text = text or ""
    starts, own = unit_starts(text), PieceTable(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return Transformed(n, "plain", None, None, own)
    ends = np.append(starts, len(text))
    first, second = sorted(int(ends[h % (n + 1)]) for h in (h1, h2))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    return Transformed(n, form, first, second, own.arranged(form, first, second))


def restore(output: str, form: str) -> PieceTable:
    """The table of the text that ``output`` was made from, from the output and its form alone."""
    own = PieceTable(output)
    return own if form == "plain" else own.restored(form)


def fill_in_middle(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, keep_text: bool = True
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), and ``output`` with
    ``keep_text``: one row per document.

    n counts units (a run of letters, or any other character). Prefix and middle end after the smaller
    and the larger of two units drawn by the id; ``transformed`` per cent are transformed, of those
    ``suffix_first`` per cent with the suffix first. Null and empty texts, and texts that hold a
    sentinel, stay plain; a null id draws like an empty one. Cuts may coincide, so parts can be
    empty. Repeated rows and ids keep their rows; rows of one id draw the same numbers. Texts of any
    length are transformed whole; rows are independent, so nothing is shuffled. Other columns are not
    read. An empty table gives an empty result.
    """
    key = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string" + ", output string" * keep_text

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                for i, t in zip(batch.column(id_column).to_pylist(), batch.column(text).to_pylist(), strict=True):
                    made = transform(t, i, seed, transformed, suffix_first)
                    output = made.output.text()
                    digests = made.output.sha256(), restore(output, made.form).sha256()
                    spans = (None, None) if made.first is None else (made.first, made.second - made.first)
                    rows.append((made.n, made.form, *spans, *digests, output)[: 6 + keep_text])
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()][: 6 + keep_text]
                names = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"][: 6 + keep_text]
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([batch.column(id_column), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [id_column, *names])

    return docs.select(id_column, text).mapInArrow(run, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), keep_text=False)


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units
), cuts AS (
  SELECT doc_id, text, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS p, greatest(h1 % (n + 1), h2 % (n + 1)) AS q,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:p], '') AS a, array_to_string(u[p + 1:q], '') AS b, array_to_string(u[q + 1:], '') AS c FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}
ORACLES = {"op11_fill_in_middle": SQL}
