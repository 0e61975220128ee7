"""Exact deduplication by an extendible-hash index on shared files.

1. Map tasks strip white space, hash what is left, and group equal texts among the rows they hold,
   comparing bytes; a group in a task is an entry. Entries (one text each) and members (no text) are
   written to the shared folder, so a text copied a billion times costs one entry a task.
2. The directory starts with one bucket and doubles until no bucket holds more than its capacity, or
   until the deepest level; it is built from a histogram of key prefixes of bounded size.
3. Owner tasks take ranges of keys: neighbouring buckets of about equal bytes, sorted by key. Entries whose
   keys collide are chained and told apart by their bytes; equal ones become one group. A key with very
   many entries (a text that every map task holds) is reduced first, in salted parts of bounded size.
4. Members learn their group from their entry; an entry has only rows of one task, so no key is hot.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_finished_shuffles, prepare, spare_name, store, task_base

_SPACE = b" \t\n\x0b\x0c\r"
_POSTINGS = "uid long, doc_id long, entry long, sha binary, key long, n long, chars long, best_id long, best_uid long, body binary"
_ARROW = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("entry", pa.int64()), ("sha", pa.binary()), ("key", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("best_id", pa.int64()), ("best_uid", pa.int64()), ("body", pa.binary())])
_FAR = 1 << 63


def _rank(chars, doc_id, uid):
    """The smallest stays: most code points, then smallest doc_id (null last), then first row."""
    return (-chars, _FAR if doc_id is None else doc_id, uid)


def _flush(rows: list, key_bits: int):
    """rows: (uid, doc_id, chars, body); one output row each, the first of an entry with the entry's data."""
    entries: dict[bytes, list] = {}
    for r in rows:
        entries.setdefault(r[3], []).append(r)
    out = []
    for body, members in entries.items():
        digest = hashlib.sha256(body).digest()
        # the index key: bits of the digest, fewer of them only to force collisions in tests
        key = int.from_bytes(digest[:8], "big") >> (64 - key_bits) << (64 - key_bits)
        best = min(members, key=lambda m: _rank(m[2], m[1], m[0]))
        entry = members[0][0]
        out.append((entry, members[0][1], entry, digest, key - _FAR, len(members), best[2], best[1], best[0], body))
        out += [(m[0], m[1], entry, digest, None, None, None, None, None, None) for m in members[1:]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)


def _index(buffer_bytes: int, key_bits: int):
    def run(batches):
        uid, rows, held = task_base(), [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                body = (text or "").encode().translate(None, _SPACE)
                rows.append((uid, doc_id, len(text or ""), body))
                held += len(body)
                uid += 1
            if held > buffer_bytes:
                yield _flush(rows, key_bits)
                rows, held = [], 0
        if rows:
            yield _flush(rows, key_bits)

    return run


def directory(histogram: dict[int, int], capacity: int, deepest: int) -> tuple[int, list[int]]:
    """Extendible hashing: (global depth, bucket of each directory slot), from bytes by prefix of ``deepest`` bits.

    A bucket over capacity splits in two by its next bit; if it was as deep as the directory, the
    directory doubles first. A bucket that holds one prefix only stays as it is: its keys are chained.
    """
    depth, slots, buckets = 0, [0], {0: (0, 0, dict(histogram))}
    todo, made = [0], 1
    while todo:
        b = todo.pop()
        local, prefix, held = buckets[b]
        if sum(held.values()) <= capacity or len(held) < 2 or local == deepest:
            continue
        if local == depth:
            depth, slots = depth + 1, [s for s in slots for _ in (0, 1)]
        bit = deepest - local - 1
        low = {k: v for k, v in held.items() if not k >> bit & 1}
        high = {k: v for k, v in held.items() if k >> bit & 1}
        buckets[b], buckets[made] = (local + 1, prefix << 1, low), (local + 1, prefix << 1 | 1, high)
        width = 1 << (depth - local - 1)
        first = (prefix << 1 | 1) * width
        slots[first : first + width] = [made] * width
        todo += [b, made]
        made += 1
    return depth, slots


def owners(histogram: dict[int, int], slots: list[int], deepest: int, tasks: int) -> list[int]:
    """The owner of each directory slot: at most ``tasks`` ranges of whole buckets, in the order of their keys, of about equal bytes."""
    width, held, bucket = (1 << deepest) // len(slots), 0, {}
    share = max(1, -(-sum(histogram.values()) // tasks))
    size = {}
    for prefix, n in histogram.items():
        b = slots[prefix // width]
        size[b] = size.get(b, 0) + n
    for b in slots:
        if b not in bucket:
            bucket[b] = min(held // share, tasks - 1)
            held += size.get(b, 0)
    return [bucket[b] for b in slots]


def _groups(batches):
    """Entries sorted by (key, salt) in; a list of (key, body, entries, rows, best) as soon as a key and salt are complete."""
    now, chain = None, []
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(8)]
        for entry, key, salt, n, chars, best_id, best_uid, body in zip(*cols):
            if (key, salt) != now:
                yield from ((now[0], *link) for link in chain)
                now, chain = (key, salt), []
            best = _rank(chars, best_id, best_uid)
            for link in chain:
                if link[0] == body:
                    link[1].append(entry)
                    link[2] += n
                    link[3] = min(link[3], best)
                    break
            else:
                chain.append([body, [entry], n, best])
    yield from ((now[0], *link) for link in chain)


def _chains(batches):
    """(entry, keep_id, keep_uid, group_size) of the owners' groups."""
    out, names = [], ["entry", "keep_id", "keep_uid", "group_size"]
    for _, _, ids, n, best in _groups(batches):
        out.extend((e, None if best[1] == _FAR else best[1], best[2], n) for e in ids)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)


_MERGED = "entry long, into long, key long, n long, chars long, best_id long, best_uid long, body binary"


def _merged(batches):
    """One entry for all equal ones of a part, and what became of the others (into)."""
    names, kinds = [c.split()[0] for c in _MERGED.split(", ")], [pa.int64()] * 7 + [pa.binary()]
    for key, body, ids, n, best in _groups(batches):
        rows = [(ids[0], ids[0], key, n, -best[0], None if best[1] == _FAR else best[1], best[2], body)] + [(e, ids[0], *[None] * 6) for e in ids[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def exact_dedup(docs: DataFrame, capacity: int = 4 << 20, deepest: int = 14, buffer_bytes: int = 32 << 20, key_bits: int = 64, hot: int = 64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): uid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters [\\x20\\x09-\\x0D]; null counts as empty.
    Of equal texts the one with the most code points stays, then the smallest doc_id (a null doc_id
    comes last), then the first row, so of rows that repeat a doc_id exactly one stays. ``uid`` is
    the row number of ``shared.with_uid``. An empty table gives an empty result.

    ``capacity``: bytes of text in a bucket before it splits; it grows with the corpus once
    2**deepest buckets would not hold it. ``hot``: entries of one key that go to a task at once.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    postings = store(rows.mapInArrow(_index(buffer_bytes, key_bits), _POSTINGS), "postings")
    data = ["entry", "key", "n", "chars", "best_id", "best_uid", "body"]
    entries = postings.where("key is not null").select(*data)
    often = store(entries.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > hot), "often")
    into = None
    if often.head(1):
        parts = entries.join(often, "key").withColumn("salt", F.pmod(F.xxhash64("entry"), F.ceil(F.col("held") / hot)))
        parts = parts.repartition("key", "salt").sortWithinPartitions("key", "salt", "entry").select("entry", "key", "salt", *data[2:])
        merged = store(parts.mapInArrow(_merged, _MERGED), "merged")
        into = merged.where("key is null").select("entry", "into")
        entries = entries.join(often, "key", "left_anti").select(*data).union(merged.where("key is not null").select(*data))
    prefix = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-_FAR)), 64 - deepest).cast("int")
    histogram = {r[0]: r[1] for r in entries.groupBy(prefix.alias("p")).agg(F.sum(F.octet_length("body")).cast("long")).collect()}
    capacity = max(capacity, 2 * sum(histogram.values()) >> deepest)
    depth, slots = directory(histogram, capacity, deepest)
    slot = F.shiftright(prefix, deepest - depth)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owner = F.element_at(F.lit(owners(histogram, slots, deepest, tasks)).cast("array<int>"), slot + 1)
    owned = entries.select("entry", "key", F.lit(0).cast("long").alias("salt"), *data[2:]).repartitionById(tasks, owner).sortWithinPartitions("key")
    found = store(owned.mapInArrow(_chains, "entry long, keep_id long, keep_uid long, group_size long"), "groups")
    if into is not None:
        found = found.union(into.join(found.withColumnRenamed("entry", "into"), "into").select("entry", "keep_id", "keep_uid", "group_size"))
    drop_finished_shuffles(spark)
    members = postings.select("uid", "doc_id", "entry", "sha")
    return members.join(found, "entry").select("uid", "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Null texts count as empty, so one of the empty ones stays; of repeated rows the first stays; an empty
    table gives an empty result.
    """
    row = spare_name(docs, "_row")
    kept = exact_dedup(docs).where("kept").select(F.col("uid").alias(row))
    return docs.withColumn(row, F.monotonically_increasing_id()).join(kept, row, "left_semi").drop(row)
