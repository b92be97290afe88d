"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the models this is for has a whitespace marker after another character, so no merge crosses the start of a
marked word: each distinct marked word is segmented once a task, and its ids are joined back by position. A model of
which that is not so, or whose normaliser changes text, is applied to whole texts instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

MARK = "▁"
#: One marked word: its run of markers, then everything up to the next marker.
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts that a normaliser other than the identity changes.
PROBES = ("a", " a  b ", "ﬁ ÅÅ\t　x", "A\nb\r c")


class ChunkTable(dict):
    """Marked word -> (number of ids, ids as text, ids, its decoded text), for at most ``most`` distinct words."""

    def __init__(self, processor, most: int):
        super().__init__()
        self.processor, self.most = processor, most
        self.bare = processor.encode("a ")[len(processor.encode("a")):]

    def __missing__(self, chunk: str) -> tuple[int, str, str]:
        if len(self) >= self.most:
            self.clear()
        ids = self.processor.encode(chunk[1:]) if len(chunk) > 1 else self.bare
        entry = self[chunk] = (len(ids), ",".join(map(str, ids)), self.processor.decode(ids) if len(chunk) > 1 else "")
        return entry


def splits_at_markers(processor) -> bool:
    """Whether chunks can be segmented on their own under this model."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
        return False
    return all(processor.normalize(p) == MARK + p.replace(" ", MARK) for p in PROBES)


def codec(model: bytes, most_chunks: int = 150_000) -> Callable[[str | None], tuple[int, str, str]]:
    """A function from a text to (number of ids, ids joined by commas, decoded text)."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    if not splits_at_markers(processor):

        def whole(text: str | None) -> tuple[int, str, str]:
            ids = processor.encode(text or "")
            return len(ids), ",".join(map(str, ids)), processor.decode(ids)

        return whole
    look_up = ChunkTable(processor, most_chunks).__getitem__

    def by_chunk(text: str | None) -> tuple[int, str, str]:
        if not text:
            return 0, "", ""
        counts, ids, decoded = zip(*map(look_up, CHUNK.findall(MARK + text.replace(" ", MARK))))
        return sum(counts), ",".join(ids), " ".join(decoded)

    return by_chunk


def read_model(path: str) -> bytes:
    """The model's bytes (about half a megabyte); they go to the executors with the task, not by path."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of each text, and the text they decode to: (id, n_tokens, ids, decoded).

    Null and empty texts have no ids and decode to ''. A null id is kept. Repeated rows give repeated results. Other
    columns are not read. Empty tables give an empty result.
    """
    model = read_model(model_path)

    def make():
        run = codec(model)

        def one(row):
            n, ids, decoded = run(row[1])
            return row[0], n, [int(i) for i in ids.split(",")] if ids else [], decoded

        return one

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(ids, make, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>, decoded string", 64)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with SHA-256 of the ids (decimal, joined by commas) and of the decoded text in place of them."""
    model = read_model(model_path)

    def make():
        run = codec(model)

        def one(row):
            n, ids, decoded = run(row[1])
            return row[0], n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return one

    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(ids, make, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
