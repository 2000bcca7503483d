"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model crosses from a letter to a whitespace marker or holds a line feed, the segmentation of a text
is that of its chunks: a run of markers and what follows up to the next marker or line feed. Each distinct chunk is
segmented and decoded once by the library, and its ids and text are joined back by position. Other models go through
the library text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
#: Chunks that each half of a table holds (one text's own chunks come on top); about 200 bytes each. When the young half
#: is full it becomes the old one, and chunks that are met again move to the new young half.
TABLE_ROWS = 100_000
#: Texts longer than this go in a batch of their own.
BATCH_BYTES = 1 << 20


class ChunkTable:
    """Encodes and decodes texts exactly as the library does with begin and end ids and no sampling."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))]
        crosses = any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        # The library must take texts as they are: a dummy marker in front, spaces kept, nothing else changed.
        probe = ["a  b \n c", " a ", "A Å\tﬁ"]
        plain = all(self.lib.decode(self.lib.encode(t)) == t for t in probe) and self.lib.encode("a", out_type=str)[0].startswith(MARK)
        self.by_chunk = plain and not crosses
        self.ends = (np.array([self.lib.bos_id()], "<u4").tobytes(), np.array([self.lib.eos_id()], "<u4").tobytes())
        self.line = self.lib.encode("\n")  # marker and line feed: what comes before a chunk without marker
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}
        self.chunks = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def _learn(self, new: list[str]) -> None:
        """Ids and text of each chunk; the texts are what the library decodes behind line feeds, where no space is taken off."""
        marked = [c for c in new if c[0] == MARK]
        bare = [c for c in new if c[0] != MARK]
        ids = dict(zip(marked, self.lib.encode([c[1:] for c in marked], num_threads=1), strict=True)) if marked else {}
        if MARK in ids:
            ids[MARK] = self.line[: len(self.line) - 1]  # one marker alone, which the library gives for no text of its own
        if bare:
            ids |= {c: x[len(self.line) :] for c, x in zip(bare, self.lib.encode(["\n" + c for c in bare], num_threads=1), strict=True)}
        feed = self.line[-1:]
        texts = self.lib.decode(list(chain.from_iterable(feed + x for x in ids.values()))).split("\n")[1:]
        data, at = np.fromiter(chain.from_iterable(ids.values()), "<u4").tobytes(), 0
        for (c, x), t in zip(ids.items(), texts, strict=True):
            self.young[c] = data[at : (at := at + 4 * len(x))], t

    def _know(self, chunks: set[str]) -> None:
        """Brings the chunks into the young half: from the old one, else from the library, all in one call."""
        self.young["\n"] = np.array(self.line[-1:], "<u4").tobytes(), "\n"
        new = chunks - self.young.keys()
        if len(self.young) + len(new) > TABLE_ROWS:
            self.young, self.old, new = {"\n": self.young["\n"]}, self.young, chunks - {"\n"}
        self.young.update((c, self.old[c]) for c in new & self.old.keys())
        if learn := new - self.young.keys():
            self._learn(list(learn))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and the text that they decode to."""
        if not self.by_chunk:
            ids = self.lib.encode(texts, num_threads=1)
            return [self.ends[0] + np.array(x, "<u4").tobytes() + self.ends[1] for x in ids], self.lib.decode(ids, num_threads=1) if ids else []
        split = [self.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        self._know(set().union(*split))
        ids, decoded, at = [], [], self.young.__getitem__
        for chunks in split:
            one, two = zip(*map(at, chunks), strict=True) if chunks else ((), ())
            ids.append(self.ends[0] + b"".join(one) + self.ends[1])
            decoded.append("".join(two)[1:])  # without the marker in front of a text
        return ids, decoded


def encoded(df: DataFrame, text: str, model_file: str, keep: list[str]) -> DataFrame:
    """keep, ids (binary: little-endian unsigned 32-bit integers, begin and end ids included) and the text decoded from them.

    A null text is encoded as an empty one. No shuffle: a task's table of distinct chunks serves all of its texts and
    keeps TABLE_ROWS chunks in each of two halves. The model file must be readable on the executors.
    """
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file)  # goes with the task: workers live on
        for b in batches:
            texts = b.column("_text").cast(pa.large_string()).fill_null("")
            ends = np.frombuffer(texts.buffers()[1], np.int64, count=len(texts) + 1, offset=8 * texts.offset)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_BYTES, "right")) - 1)
                ids, decoded = table.encode(texts.slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(f.name).slice(i, j - i) for f in fields), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*(f.name for f in fields), "ids", "decoded"])
                i = j

    return df.select(*[F.col(f"`{f.name}`") for f in fields], F.col(text).alias("_text")).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs (doc_id, text); repeated rows give equal rows."""
    out = encoded(docs, "text", model_file, ["doc_id"])
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
