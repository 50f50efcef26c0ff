"""Packing: concatenate token streams and cut them into fixed windows.

Pass one tokenises each document once, in input-split order, and writes ids with the offset inside
the split. Prefix sums over the splits' totals (one row a split) give global offsets. Pass two cuts
fixed windows; a document across a boundary yields one boundary record a window.

Defined cases: null or empty text is the end token alone; null ``doc_id`` is packed like any other
and keeps its null; repeated rows are packed as often as they occur; an empty table gives no pieces;
further columns are ignored. A text of any length is cut over as many windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Texts whose characters all lie below this code point are split alike by both tokenizer libraries.
_PLAIN = 0x250
#: Offsets of so many splits (16 MB of rows) are broadcast; beyond that Spark picks the join.
_BROADCAST_SPLITS = 1 << 20
_TOKENIZERS: dict[str, tuple] = {}


def _tokenizers(json_path: str, ranks_path: str, control_as_text: bool):
    """The JSON tokenizer, its control strings, and the faster library over the same vocabulary (as ranks)."""
    key = json_path, ranks_path, control_as_text
    if key not in _TOKENIZERS:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        exact.encode_special_tokens = control_as_text
        control = () if control_as_text else tuple(t.content for t in exact.get_added_tokens_decoder().values())
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _TOKENIZERS[key] = exact, control, fast
    return _TOKENIZERS[key]


def tokenize(text: str | None, json_path: str, ranks_path: str, control_as_text: bool = False) -> np.ndarray:
    """Ids of ``text`` as the JSON tokenizer gives them without adding special tokens.

    A control string inside a text becomes its control id, unless ``control_as_text`` is set.
    """
    if not text:
        return np.zeros(0, np.uint32)
    exact, control, fast = _tokenizers(json_path, ranks_path, control_as_text)
    if (text.isascii() or ord(max(text)) < _PLAIN) and not any(c in text for c in control):
        return np.asarray(fast.encode_ordinary(text), np.uint32)
    return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)


_IDS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("local", pa.int64()), ("ids", pa.binary())])
_IDS_DDL = "part long, doc_id long, n long, local long, ids binary"


def _token_rows(json_path: str, ranks_path: str, end_id: int, control_as_text: bool, flush: int = 8 << 20):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        cols: list[list] = [[], [], [], []]
        held = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([part] * len(cols[0]), pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], schema=_IDS)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(tokenize(text.as_py(), json_path, ranks_path, control_as_text), np.uint32(end_id)).astype("<u4")
                # ids below 2**16 take two bytes
                data = b"\x02" + ids.astype("<u2").tobytes() if ids.max() < 1 << 16 else b"\x04" + ids.tobytes()
                for c, v in zip(cols, (doc, len(ids), local, data), strict=True):
                    c.append(v)
                local, held = local + len(ids), held + len(data)
                if held >= flush:
                    yield batch()
                    cols, held = [[], [], [], []], 0
        if cols[0]:
            yield batch()

    return rows


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pieces(size: int, with_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in _PIECES]
            held = 0
            for doc, n, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                raw = data.as_py()
                ids, start = np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype("<u4"), 0
                while start < n:
                    seq, off = divmod(at + start, size)
                    length = min(n - start, size - off)
                    piece = ids[start : start + length].tobytes()
                    for c, v in zip(out, (doc, start, length, zlib.crc32(piece), n, seq, off, piece if with_ids else None), strict=True):
                        c.append(v)
                    start, held = start + length, held + (len(piece) if with_ids else 64)
                    if held >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)
                        out, held = [[] for _ in _PIECES], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES, strict=True)], schema=_PIECES)

    return rows


@shared.tidied
def pack(docs: DataFrame, json_path: str, ranks_path: str, size: int = 2048, end_id: int = 1, with_ids: bool = True, control_as_text: bool = False) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    Sequences hold ``size`` ids, gapless from 0; the last one is shorter and is the only one that a
    loader pads. ``ids`` is little-endian unsigned 32-bit, null without ``with_ids``.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = shared.written(source.mapInArrow(_token_rows(json_path, ranks_path, end_id, control_as_text), _IDS_DDL), "tokens")
    totals = shared.written(tokens.groupBy("part").agg(F.sum("n").alias("total")), "totals")
    # one row an input split: a single ordered window over it stays small at any input size
    bases = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    if totals.count() <= _BROADCAST_SPLITS:
        bases = F.broadcast(bases)
    placed = tokens.join(bases, "part").select("doc_id", "n", (F.col("base") + F.col("local")).alias("at"), "ids")
    return placed.mapInArrow(_pieces(size, with_ids), _PIECES_DDL)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(shared.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=False)
    return pieces.drop("ids")
