"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

Encoding works on the distinct pieces of a stretch of documents.  A recursive
query holds one row per (piece, position, token): each round joins neighbouring
tokens to the merge table, takes every piece's leftmost pair of minimum rank,
contracts it and drops pieces without one, to a fixpoint.  A query makes at most
``ROUNDS`` rounds; pieces that are not at their fixpoint then go on in the next
one from where they stand, so that memory is bounded by bytes x rounds and not
by all rounds of the longest piece.  Decoding joins token rows to the vocabulary
and aggregates the bytes in order.

Two kinds of piece need no recursion: a piece that is a token stands for itself
(the library's rule too), and one of more than ``LONG_PIECE`` bytes, which would
take a round over all its rows for each of its merges, goes by a heap.

The merge table holds every split of every token into two tokens, with the
token's rank, so that adjacent tokens merge exactly if their bytes are a token.
Rank files and pattern are parameters; nothing is trained.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellurian.llm.store import text_slices

#: A query takes pieces of so many bytes together and makes so many rounds; text is gathered to this much.
QUERY_BYTES = 1 << 18
ROUNDS = 12
GATHER_BYTES = 4 << 20
#: Pieces kept from one stretch of documents to the next.
CACHE_PIECES = 150_000
#: A round contracts one pair of each piece, so that pieces beyond this length go by a heap instead.
LONG_PIECE = 256
SEGMENT = 1 << 16
DECODE_ROWS = 1 << 18
PLACE = 1 << 24

#: A token's row is keyed by piece << 16 | position; no piece of a query is longer than that.
#: Of each piece the rows of its last round come out, with the number of that round.
ENCODE = f"""
WITH RECURSIVE t(k, tok, round) AS (
    SELECT k, tok, 0 FROM start
    UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT k, tok, round, before, CASE WHEN nk >> 16 = k >> 16 THEN id * {PLACE}::BIGINT + (k & 65535) END AS place
        FROM (
            SELECT k, tok, round, lead(tok) OVER s AS nxt, lead(k) OVER s AS nk, lag(k) OVER s AS before
            FROM t WHERE round < {ROUNDS} WINDOW s AS (ORDER BY k)
        ) LEFT JOIN merges ON l = tok AND r = nxt),
    least AS (SELECT k >> 16 AS w, min(place) AS best FROM pairs WHERE place IS NOT NULL GROUP BY k >> 16)
    SELECT k, CASE WHEN (k & 65535) = best % {PLACE} THEN (best // {PLACE})::INTEGER ELSE tok END, round + 1
    FROM pairs JOIN least ON k >> 16 = w
    WHERE before IS NULL OR before <> (w << 16) + best % {PLACE})
)
SELECT k, tok, round
FROM t JOIN (SELECT k >> 16 AS w, max(round) AS final FROM t GROUP BY k >> 16) ON k >> 16 = w AND round = final
ORDER BY k
"""

DECODE = "SELECT seg, string_agg(hex, '' ORDER BY pos) AS hex FROM tokens JOIN vocab USING (id) GROUP BY seg ORDER BY seg"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = None
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def connection(self):
        if self.db is None:
            import duckdb

            self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
            known = self.ranks
            splits = [(known[t[:i]], known[t[i:]], id) for t, id in known.items() for i in range(1, len(t)) if t[:i] in known and t[i:] in known]
            left, right, ids = (pa.array(x, pa.int32()) for x in zip(*splits, strict=True))
            merges = pa.table({"l": left, "r": right, "id": ids})
            vocab = pa.table({"id": pa.array(known.values(), pa.int32()), "hex": [t.hex() for t in known]})
            for name, table in (("merges", merges), ("vocab", vocab)):
                self.db.register("given", table)
                self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
                self.db.unregister("given")
        return self.db

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long piece, by a heap over linked positions."""
        n = len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < n:
                stop = end[end[at]]
                if (rank := self.ranks.get(piece[at:stop])) is not None:
                    heapq.heappush(heap, (rank, at, end[at], stop))

        for i in range(n):
            offer(i)
        while heap:
            _, at, mid, stop = heapq.heappop(heap)
            if not alive[at] or end[at] != mid or mid >= n or end[mid] != stop:
                continue
            alive[mid] = False
            end[at] = stop
            if stop < n:
                before[stop] = at
            offer(before[at])
            offer(at)
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : end[at]]])
            at = end[at]
        return np.array(ids, dtype="<u4").tobytes()

    def _query(self, pieces: list[str], raw: list[bytes]) -> None:
        db = self.connection()
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        starts = np.cumsum(sizes) - sizes
        tok = self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        k = (np.repeat(np.arange(len(raw), dtype=np.int64), sizes) << 16) + np.arange(len(tok)) - np.repeat(starts, sizes)
        while len(k):
            db.register("start", pa.table({"k": k, "tok": tok}))
            found = db.execute(ENCODE).fetchnumpy()
            db.unregister("start")
            k, tok = np.asarray(found["k"]), np.asarray(found["tok"])
            done = np.asarray(found["round"]) < ROUNDS
            ids = tok[done].astype("<u4")
            w = k[done] >> 16
            edges = [0, *(np.flatnonzero(np.diff(w)) + 1).tolist(), len(w)]
            self.cache.update((pieces[w[lo]], ids[lo:hi].tobytes()) for lo, hi in zip(edges, edges[1:], strict=False) if lo < hi)
            k, tok = k[~done], tok[~done]

    def learn(self, wanted: set[str]) -> list[str]:
        """Puts the ids of all these pieces into the cache; returns the long ones, which should not stay there."""
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        pieces, raw, size = [], [], 0
        long: list[str] = []
        for p in wanted:
            if p in self.cache:
                continue
            if (known := self.older.get(p)) is not None:
                self.cache[p] = known
                continue
            b = p.encode()
            if (whole := self.ranks.get(b)) is not None:
                self.cache[p] = whole.to_bytes(4, "little")
            elif len(b) > LONG_PIECE:
                self.cache[p] = self.merge_long(b)
                long.append(p)
            else:
                pieces.append(p)
                raw.append(b)
                size += len(b)
                if size >= QUERY_BYTES:
                    self._query(pieces, raw)
                    pieces, raw, size = [], [], 0
        if pieces:
            self._query(pieces, raw)
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and size < GATHER_BYTES:
                size += len(texts[to])
                to += 1
            split = [self.pattern.findall(t) for t in texts[at:to]]
            long = self.learn({p for ps in split for p in ps})
            of = self.cache.__getitem__
            out.extend(b"".join(map(of, ps)) for ps in split)
            for p in long:
                del self.cache[p]
            at = to
        return out

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids."""
        db, out = self.connection(), [b""] * len(rows)
        segments: list[tuple[int, np.ndarray]] = []
        held = 0

        def run() -> None:
            sizes = [len(x) for _, x in segments]
            seg = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
            db.register("tokens", pa.table({"seg": seg, "pos": np.arange(len(seg), dtype=np.int32), "id": np.concatenate([x for _, x in segments]).astype(np.int32)}))
            for s, h in db.execute(DECODE).fetchall():
                out[segments[s][0]] += bytes.fromhex(h)
            db.unregister("tokens")
            segments.clear()

        for i, row in enumerate(rows):
            ids = np.frombuffer(row, dtype="<u4")
            for at in range(0, len(ids), SEGMENT):
                segments.append((i, ids[at : at + SEGMENT]))
                held += len(segments[-1][1])
                if held >= DECODE_ROWS:
                    run()
                    held = 0
        if segments:
            run()
        return out


_CODECS: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    name, ranks, pattern = shared.value
    if name not in _CODECS:
        _CODECS[name] = Codec(ranks, pattern)
    return _CODECS[name]


def _share(spark: SparkSession, path: str, pattern: str):
    """The vocabulary, whose size is that of the rank file, for all executors."""
    return spark.sparkContext.broadcast((f"{path}\n{pattern}", read_ranks(path), pattern))


def _ids_array(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def _rows(ids: pa.ListArray) -> list[bytes]:
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")
    edges = [0, *np.cumsum(sizes).tolist()]
    return [flat[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the tokens of each whole text, without special tokens.

    A null or empty text has no tokens.  Rows are independent, so that repeated
    rows repeat; other columns are ignored; an empty table gives an empty result.
    """
    shared = _share(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            rows = _codec(shared).encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), _ids_array(rows)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, bytes: what the ids stand for; null ids stand for nothing.  Unknown ids are passed over."""
    shared = _share(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_codec(shared).decode(_rows(b.column(1))), pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids and keeps the digests.

    Both steps share one worker, so that ids need not travel between two.
    """
    shared = _share(docs.sparkSession, path, pattern)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 1):
            codec = _codec(shared)
            rows = codec.encode([t or "" for t in b.column(1).to_pylist()])
            back = codec.decode(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array(map(sha, rows), pa.string()), pa.array(map(sha, back), pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
