"""Exact dedup by an extendible-hash index on shared files.

1. *Scan.*  Every input task hashes whole texts and groups equal ones inside
   bounded windows, comparing bytes, so that a group of millions of copies
   reaches the index as one entry per window and never as one row per copy.
   Each local class gets a number; the row to be kept carries the text.
2. *Directory.*  Entry bytes are counted by the leading 18 bits of the key (at
   most 262,144 counters reach the driver).  Starting from one bucket, overfull
   buckets split on their next bit and the directory doubles whenever a bucket
   is as deep as the directory itself.  A bucket holds 16 MiB, and beyond
   32,768 buckets so much more that the counters still tell eight parts of one:
   no bucket is larger than that, but for texts that share those 18 bits.
3. *Owner tasks.*  A bucket is a contiguous key range and belongs to one task.
   It reads its entries in key order (a sort that spills), chains texts that
   share a key, compares their bytes and writes index entries (class, kept
   document, group size) to the shared folder.  Memory holds the chain of one
   key at a time, whatever the bucket's size.
4. Rows meet their class by its number, which no more than one window of rows
   carries, so that this join has no hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.llm.store import materialise, text_slices

WINDOW_BYTES = 16 << 20
WINDOW_ROWS = 8192
BUCKET_BYTES = 16 << 20
MAX_DEPTH = 18
MOST_BUCKETS = 1 << 15

SCAN = "doc_id long, cls long, lead boolean, key long, n long, best long, text binary, sha string"
INDEX = "bucket int, key long, chain int, cls long, wins boolean, keep_id long, group_size long, text_sha256 string"


def sha_key(text: bytes) -> int:
    """Leading 64 bits of SHA-256 as an unsigned integer."""
    return int.from_bytes(hashlib.sha256(text).digest()[:8], "big")


def _order(doc_id: int | None) -> tuple[bool, int]:
    return (doc_id is not None, doc_id or 0)


def _scanner(key_of: Callable[[bytes], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(rows: list, classes: list, first: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8)]
        for at, (doc_id, c) in enumerate(rows):
            text, key, n, best, lead = classes[c]
            own = lead == at
            for col, v in zip(cols, (doc_id, first + c, own, key - (1 << 63), n, best, text if own else None, hashlib.sha256(text).hexdigest() if own else None), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        names = [x.split()[0] for x in SCAN.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 36
        rows, classes, chains, size = [], [], {}, 0
        for batch in text_slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                text = text or b""
                key = key_of(text)
                chain = chains.setdefault(key, [])
                c = next((c for c in chain if classes[c][0] == text), None)
                if c is None:
                    c = len(classes)
                    chain.append(c)
                    classes.append([text, key, 0, doc_id, len(rows)])
                    size += len(text)
                entry = classes[c]
                entry[2] += 1
                if _order(doc_id) > _order(entry[3]):
                    entry[3], entry[4] = doc_id, len(rows)
                rows.append((doc_id, c))
                if size >= WINDOW_BYTES or len(rows) >= WINDOW_ROWS:
                    yield flush(rows, classes, serial)
                    serial += len(classes)
                    rows, classes, chains, size = [], [], {}, 0
        if rows:
            yield flush(rows, classes, serial)

    return scan


def build_directory(cells: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """Extendible hashing over counts of key prefixes.

    ``cells`` maps the leading ``max_depth`` bits of a key to the bytes stored
    below it.  Returns the global depth and, for each directory slot, the
    number of its bucket; buckets are numbered in key order.
    """
    prefix = [0]
    for i in range(1 << max_depth):
        prefix.append(prefix[-1] + cells.get(i, 0))
    load = lambda at, depth: prefix[(at + 1) << (max_depth - depth)] - prefix[at << (max_depth - depth)]
    depth, slots = 0, [(0, 0)]  # each slot: (bucket prefix, local depth)
    overfull = [(0, 0)] if load(0, 0) > capacity else []
    while overfull:
        at, local = overfull.pop()
        if local == max_depth:
            continue
        if local == depth:
            slots = [s for s in slots for _ in range(2)]
            depth += 1
        width = 1 << (depth - local - 1)
        for half in range(2):
            child = (at * 2 + half, local + 1)
            start = child[0] * width
            slots[start : start + width] = [child] * width
            if load(*child) > capacity:
                overfull.append(child)
    number: dict[tuple[int, int], int] = {}
    return depth, [number.setdefault(s, len(number)) for s in slots]


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in INDEX.split(", ")]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
    out: list[tuple] = []

    def close(bucket: int, key: int, chain: list) -> None:
        for at, (_, sha, entries) in enumerate(chain):
            winner = max(entries, key=lambda e: (*_order(e[1]), -e[0]))
            total = sum(e[2] for e in entries)
            out.extend((bucket, key, at, cls, cls == winner[0], winner[1], total, sha) for cls, _, _ in entries)

    def batch() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    current, chain = None, []
    for b in text_slices(batches, 5):
        for bucket, key, cls, best, n, text, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if current != (bucket, key):
                if chain:
                    close(*current, chain)
                current, chain = (bucket, key), []
            entry = next((x for x in chain if x[0] == text), None)
            if entry is None:
                entry = (text, sha, [])
                chain.append(entry)
            entry[2].append((cls, best, n))
        if len(out) > 4096:
            yield batch()
    if chain:
        close(*current, chain)
    yield batch()


def _buckets(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int, key_of: Callable[[bytes], int]) -> tuple[DataFrame, int, list[int], DataFrame]:
    """Scanned rows, the directory (its depth and slots), and the entries as their buckets' owners read them."""
    rows = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_scanner(key_of), SCAN),
        "exact-scan",
    )
    entries = rows.where("lead").select("key", "cls", "best", "n", "text", "sha")
    cell = F.shiftrightunsigned(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), 64 - MAX_DEPTH)
    cells = {r[0]: r[1] for r in entries.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("text") + 64)).collect()}
    depth, slots = build_directory(cells, max(bucket_bytes, sum(cells.values()) // MOST_BUCKETS))
    owned = entries.withColumn("bucket", _bucket_of("key", depth, slots)).repartitionById(max(slots) + 1, "bucket").sortWithinPartitions("bucket", "key", "cls")
    return rows, depth, slots, owned


def _bucket_of(key: str, depth: int, slots: list[int]) -> Column:
    """The bucket of a key's directory slot."""
    slot = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(-(1 << 63))), 64 - depth).cast("int") if depth else F.lit(0)
    return (F.element_at(_directory(slots), slot + 1) if depth else F.lit(0)).cast("int")


def _directory(slots: list[int]) -> Column:
    """The directory as one constant array, of 262,144 slots at most."""
    return F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    key_of: Callable[[bytes], int] = sha_key,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal
    texts the row with the largest id stays.  A null id ranks below all others;
    of rows that repeat both id and text exactly one stays.  Any other column of
    ``docs`` is ignored, an empty table gives an empty result.
    """
    rows, _, _, owned = _buckets(docs, id_col, text_col, bucket_bytes, key_of)
    index = materialise(owned.select("bucket", "key", "cls", "best", "n", "text", "sha").mapInArrow(_own, INDEX), "exact-index")
    return (
        rows.select("doc_id", "cls", "lead")
        .join(index.select("cls", "wins", "keep_id", "group_size", "text_sha256"), "cls")
        .select("doc_id", "keep_id", "group_size", (F.col("lead") & F.col("wins")).alias("kept"), "text_sha256")
    )


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes an index that outlives the session: ``path/directory`` and ``path/buckets``.

    The directory has a row per slot (slot, bucket, depth); the buckets hold one
    row per distinct text (key, text, keep_id, group_size), a folder for each.
    """
    spark = docs.sparkSession
    _, depth, slots, owned = _buckets(docs, id_col, text_col, bucket_bytes, sha_key)
    slot = F.posexplode(_directory(slots)).alias("slot", "bucket")
    spark.range(1).select(slot, F.lit(depth).alias("depth")).write.parquet(f"{path}/directory")
    index = materialise(owned.select("bucket", "key", "cls", "best", "n", "text", "sha").mapInArrow(_own, INDEX), "exact-index")
    texts = owned.select("cls", "text").join(index.where("wins"), "cls")
    texts.select("bucket", "key", "text", "keep_id", "group_size").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/buckets")


def lookup(spark: SparkSession, path: str, text: str | None) -> DataFrame:
    """keep_id, group_size of one text in a written index, no row if it is not there: reads one slot and one bucket."""
    given = (text or "").encode()
    key = sha_key(given)
    slots = spark.read.parquet(f"{path}/directory")
    depth = slots.select("depth").first()[0]
    bucket = slots.where(F.col("slot") == (key >> (64 - depth) if depth else 0)).first()["bucket"]
    found = spark.read.parquet(f"{path}/buckets").where((F.col("bucket") == bucket) & (F.col("key") == key - (1 << 63)))
    return found.where(F.col("text") == F.lit(given)).select("keep_id", "group_size")
