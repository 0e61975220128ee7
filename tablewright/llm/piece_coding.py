"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from a non-space into a white-space marker, and none holds a line break
beside other characters, so a text can be cut before spaces and around line breaks, and each part
segmented on its own.

1. Texts are gathered in blocks of neighbouring rows, bounded by bytes. Each block sends its distinct
   marked words to the owners of their hash buckets, one packed row a block and bucket.
2. An owner holds the table of its bucket, segments each word when it first meets it, and answers
   every block with the ids: a word reaches the library once in the whole corpus.
3. The block's texts meet its answers, and ids are put together by position.

A word that very many documents hold is one entry a block, so no key is hot. An owner's table is
started anew when it holds ``most`` words, so memory is bounded if there are too few buckets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare, with_uid

_CHUNK = re.compile(r" *[^ \n]+|\n| +")
_ROWS = "block long, kind int, part int, body binary"
MARK = "▁"


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if MARK in piece.lstrip(MARK) or ("\n" in piece and len(piece) > 1):
            raise ValueError(f"piece {piece!r} crosses a chunk's border; chunks cannot be segmented alone")
    return model


class ChunkTable:
    """Ids (as text) of each distinct chunk of a text, its first one left out; and the chunks that do not decode to themselves."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.model, self.most = _model(path), most
        self.space = self.model.piece_to_id(MARK)
        self.line = self.model.encode("\n")[1:]
        self.shown: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.learn(["\n"])
        self._line = dict(self.shown), dict(self.odd)

    def clear(self) -> None:
        """Forget all but the line break."""
        self.shown, self.odd = map(dict, self._line)

    def learn(self, chunks) -> None:
        if len(self.shown) > self.most:
            self.clear()
        new = [c for c in chunks if c not in self.shown]
        if not new:
            return
        # the model marks a text's begin as a space does, so a space is left to it; a line break shields the others
        asked = self.model.encode([c[1:] if c[0] == " " else "\n" + c for c in new], num_threads=1)
        skip = 1 + len(self.line)
        asked = [[self.space] if c == " " else ids if c[0] == " " else ids[skip:] for c, ids in zip(new, asked)]
        told = self.model.decode([self.line + ids for ids in asked], num_threads=1)
        for c, ids, text in zip(new, asked, told):
            self.shown[c] = ",".join(map(str, ids))
            if text[1:] != c or not ids:
                self.odd[c] = text[1:]


def _packed(**columns: pa.Array) -> bytes:
    """A record batch as compressed bytes."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(body) -> list[list]:
    with pa.ipc.open_stream(body) as read:
        return [c.to_pylist() for c in read.read_next_batch().columns]


def _joined(values: list[str]) -> pa.Array:
    """One string of values without line breaks, which packs better than a list."""
    return pa.array(["\n".join(values)], pa.large_string())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    block, kind, part, body = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["block", "kind", "part", "body"])


def _cut(text: str) -> list[str] | None:
    """Chunks of a text; None for a text with the marker itself, which the library takes whole."""
    return None if MARK in text else _CHUNK.findall(text)


def _runs(batches, most: int):
    """(block, doc_ids, texts, whether the block ends): neighbouring rows of a task, named by the first one's number. Where a block ends depends on the rows only, not on the batches."""
    block, held = None, 0
    for b in batches:
        docs, texts, uids, start = b.column(0), [t or "" for t in b.column(1).to_pylist()], b.column(2).to_pylist(), 0
        for i, text in enumerate(texts):
            block = uids[i] if block is None else block
            held += len(text) + 16
            if held >= most:
                yield block, docs.slice(start, i + 1 - start), texts[start : i + 1], True
                block, held, start = None, 0, i + 1
        if start < len(texts):
            yield block, docs.slice(start), texts[start:], False


def _texts(most: int):
    """Rows of kind 1: the texts of a block, a few at a time."""

    def run(batches):
        last, part = None, 0
        for block, docs, texts, _ in _runs(batches, most):
            last, part = block, part + 1 if block == last else 0
            yield _rows([(block, 1, part, _packed(doc_id=docs, text=pa.array(texts, pa.large_string())))])

    return run


def _words(most: int, buckets: int):
    """Rows of kind 0: the distinct chunks of a block but the line break, one row a bucket."""

    def told(block: int, seen: set[str]):
        seen.discard("\n")
        dealt: list[list[str]] = [[] for _ in range(buckets)]
        for c in seen:
            dealt[zlib.crc32(c.encode()) % buckets].append(c)
        rows = [(block, 0, n, _packed(chunks=_joined(sorted(chunks)))) for n, chunks in enumerate(dealt) if chunks]
        for i in range(0, len(rows), 64):
            yield _rows(rows[i : i + 64])

    def run(batches):
        seen: set[str] = set()
        block = None
        for block, _, texts, ends in _runs(batches, most):
            for text in texts:
                seen.update((_cut(text) or [])[1:])
            if ends:
                yield from told(block, seen)
                seen = set()
        if seen:
            yield from told(block, seen)

    return run


def _owner(path: str):
    """The chunks of a row with their ids, and what they decode to if that is not themselves; rows come bucket by bucket."""

    def run(batches):
        table, bucket = ChunkTable(path), None
        for b in batches:
            out = []
            for block, kind, part, body in zip(*[c.to_pylist() for c in b.columns]):
                if part != bucket:
                    bucket = part
                    table.clear()
                chunks = _unpacked(body)[0][0].split("\n")
                table.learn(chunks)
                odd = [c for c in chunks if c in table.odd]
                told = {"chunks": _joined(chunks), "ids": _joined([table.shown[c] for c in chunks])}
                told |= {"odd": pa.array([odd], pa.list_(pa.large_string())), "read": pa.array([[table.odd[c] for c in odd]], pa.list_(pa.large_string()))}
                out.append((block, kind, part, _packed(**told)))
            if out:
                yield _rows(out)

    return run


def _code(path: str, with_ids: bool):
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def coded(text: str, table: ChunkTable) -> tuple:
        model, chunks = table.model, _cut(text)
        if not chunks:  # nothing, or the marker itself in a text
            ids = model.encode(text)
            code, back = ",".join(map(str, ids)), model.decode(ids)
        else:
            head, first, rest = chunks[0], model.encode(chunks[0]), chunks[1:]
            shown, odd = table.shown, table.odd
            parts = [",".join(map(str, first)), *[shown[c] for c in rest]]
            if not odd or odd.keys().isdisjoint(rest):
                back = model.decode(first) + text[len(head) :]
            else:
                parts = [p for p in parts if p]
                back = model.decode(first) + "".join([odd.get(c, c) for c in rest])
            code = ",".join(parts)
        n = code.count(",") + 1 if code else 0
        return n, hashlib.sha256(code.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), [int(x) for x in code.split(",") if x] if with_ids else None

    def run(batches):
        table, current = ChunkTable(path), None
        for b in batches:
            for block, kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if block != current:
                    current = block
                    table.clear()
                if kind == 0:
                    (chunks,), (ids,), (odd,), (read,) = _unpacked(body)
                    table.shown.update(zip(chunks.split("\n"), ids.split("\n")))
                    table.odd.update(zip(odd, read))
                    continue
                docs, texts = _unpacked(body)
                n, code, back, ids = zip(*[coded(t, table) for t in texts])
                cols = [pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(code), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    return run


def piece_coding(docs: DataFrame, model_path: str, with_ids: bool = False, block: int = 40_000_000, owners: int = 4096) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Ids are those of the library's encode of the whole text (null: empty), without begin or end ids;
    the decoded text is that of its decode of these ids. An empty text has no ids. An empty table
    gives an empty result; repeated rows give repeated results. A block ends at the text that brings
    it to ``block`` characters; a longer text is a block of its own or ends one. There are as many
    buckets as shuffle partitions, or as files' splits if these are more, but never over ``owners``: so many rows
    at most a block sends and gets back, however large the corpus is. An owner reads its rows as a stream.
    ``docs`` must be a deterministic read (files): it is read for the words and for the texts, and both must
    form the same blocks.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = with_uid(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    buckets = min(parts, owners)
    # by number, not by its hash: every owner is a task of its own
    words = rows.mapInArrow(_words(block, buckets), _ROWS).repartitionById(buckets, "part").sortWithinPartitions("part")
    answers = words.mapInArrow(_owner(model_path), _ROWS)
    met = answers.unionByName(rows.mapInArrow(_texts(block), _ROWS)).repartition(parts, "block").sortWithinPartitions("block", "kind", "part")
    return met.mapInArrow(_code(model_path, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
