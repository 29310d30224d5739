"""Vector code compression: product codes whose distances are integer Walsh-Hadamard sums with early elimination."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quiltlens.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
ROWS = 512  # vectors compared at once
STEP = 4  # coefficients between two eliminations
DENSE = 0.25  # share of entries still alive below which they are followed one by one


def sequency_order(n: int) -> np.ndarray:
    """Rows of the natural Hadamard order of ``n`` (a power of two) by their number of sign changes."""
    bits = n.bit_length() - 1
    gray = np.arange(n) ^ (np.arange(n) >> 1)
    out = np.zeros(n, dtype=np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of each row, zero-padded to a power of two, coefficients in sequency order.

    The squared distance of two transformed rows is ``n`` times that of the rows, ``n`` the padded length.
    """
    n = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), n), dtype=np.int64)
    out[:, :rows.shape[1]] = rows
    half = 1
    while half < n:
        pairs = out.reshape(len(rows), n // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), n)
        half *= 2
    return np.ascontiguousarray(out[:, sequency_order(n)])


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed row the nearest transformed entry (ties: the lower index) and the squared distance, unscaled.

    Squared differences are summed coefficient by coefficient. After every few, the whole distance to the entry that
    leads so far bounds the result from above, and entries whose sum is already larger are out. Sums only grow, so
    nothing that could still win or tie is lost; all numbers are integers.
    """
    found, dist = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    n = rows.shape[1]
    for a in range(0, len(rows), ROWS):
        x = rows[a:a + ROWS]
        sums = np.zeros((len(x), len(entries)), dtype=np.int64)
        at, bound = 0, None
        while at < n:
            for j in range(at, min(at + STEP, n)):
                gap = x[:, j, None] - entries[None, :, j]
                gap *= gap
                sums += gap
            at = min(at + STEP, n)
            lead = ((x - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)
            bound = lead if bound is None else np.minimum(bound, lead)
            alive = sums <= bound[:, None]
            if np.count_nonzero(alive) <= DENSE * alive.size:
                break
        row, entry = np.nonzero(alive)
        held = sums[row, entry]
        for at in range(at, n, STEP):
            for j in range(at, min(at + STEP, n)):
                gap = x[row, j] - entries[entry, j]
                held += gap * gap
            keep = held <= bound[row]
            row, entry, held = row[keep], entry[keep], held[keep]
        order = np.lexsort((entry, held, row))
        first = order[np.append(True, row[order][1:] != row[order][:-1])]
        found[a:a + ROWS], dist[a:a + ROWS] = entry[first], held[first] // n
    return found, dist


def usable(vector: Column) -> Column:
    """The vector is there and holds only finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(df: DataFrame, vector_col: str, id_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``id, label, x``: the usable vectors, each component as floor(scale * component)."""
    vector = df[vector_col].cast("array<double>")
    kept = df.select(df[id_col].alias("id"), df[label_col].alias("label"), vector.alias("v")).filter(usable(F.col("v")))
    return kept.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` numbers; shorter vectors end in zeros."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat, offsets = flat[offsets[0]:offsets[-1]], offsets - offsets[0]
    out = np.zeros((len(column), width), dtype=np.int64)
    lengths = np.diff(offsets)
    if len(flat):
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)] = flat
    return out


def _pieces(batch: pa.RecordBatch, width: int, parts: int):
    """Per part position the rows of a batch; batches are cut so that no more than a few megabytes are held."""
    per = max(ROWS, 4_000_000 // max(1, 8 * width))
    for a in range(0, batch.num_rows, per):
        piece = batch.slice(a, per)
        x = _matrix(piece.column("x"), width)
        yield piece, np.split(x, parts, axis=1)


def fit_codebooks(cells: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """``parts x entries x width / parts`` integers from ``cells(id, label, x)``: rounds of nearest entries and floored means.

    The first entries are the parts of the vectors with the smallest ids (null ids last, equal ids by their vectors);
    with fewer vectors there are fewer entries. Tasks add up their own sums; the driver gets one sum per part, entry and
    position, a number that does not depend on the input.
    """
    spark = cells.sparkSession
    first = cells.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    books = np.zeros((parts, len(first), width // parts), dtype=np.int64)
    for e, row in enumerate(first):
        whole = np.zeros(width, dtype=np.int64)
        whole[:len(row.x)] = row.x
        books[:, e] = whole.reshape(parts, -1)
    for _ in range(rounds if len(first) else 0):
        held = spark.sparkContext.broadcast(books)  # entries x width numbers

        def add_up(batches, held=held):
            own = held.value
            shifted = [walsh(b) for b in own]
            sums, counts = np.zeros(own.shape, dtype=np.int64), np.zeros(own.shape[:2], dtype=np.int64)
            for batch in batches:
                for _, split in _pieces(batch, width, parts):
                    for p, x in enumerate(split):
                        entry, _ = nearest(walsh(x), shifted[p])
                        np.add.at(sums[p], entry, x)
                        counts[p] += np.bincount(entry, minlength=own.shape[1])
            part, entry = np.nonzero(counts)
            at = np.tile(np.arange(-1, own.shape[2]), len(part))
            total = np.concatenate([counts[part, entry][:, None], sums[part, entry]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(v, own.shape[2] + 1).astype(np.int32)) for v in (part, entry)] + [pa.array(at.astype(np.int32)), pa.array(total)],
                                             names=["part", "entry", "at", "total"])

        totals = cells.select("x").mapInArrow(add_up, "part int, entry int, at int, total long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
        got = totals.toPandas()  # at most entries x (width + parts) rows
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        n = got[got["at"] < 0]
        counts[n["part"], n["entry"]] = n["total"]
        s = got[got["at"] >= 0]
        books = books.copy()
        books[s["part"], s["entry"], s["at"]] = s["total"] // counts[s["part"], s["entry"]]
        held.destroy()
    return books


def encode(cells: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error`` of ``cells(id, label, x)``: entry numbers in part order, two hex digits each, and the squared error."""
    parts, _, each = books.shape
    width = parts * each
    held = cells.sparkSession.sparkContext.broadcast(books)

    def look_up(batches):
        shifted = [walsh(b) for b in held.value]
        for batch in batches:
            for piece, split in _pieces(batch, width, parts):
                codes, error = np.zeros((piece.num_rows, parts), dtype=np.uint8), np.zeros(piece.num_rows, dtype=np.int64)
                for p, x in enumerate(split):
                    entry, dist = nearest(walsh(x), shifted[p])
                    codes[:, p] = entry
                    error += dist
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                                 names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    return cells.mapInArrow(look_up, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def reconstruct(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The integer vectors that codes stand for."""
    at = np.array([list(bytes.fromhex(c)) for c in codes], dtype=np.int64).reshape(len(codes), len(books))
    return np.concatenate([books[p][at[:, p]] for p in range(len(books))], axis=1)


def vector_codes(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id_col, code, error, label_error, codebooks_sha256`` of every usable vector.

    Vectors that are null or hold a null or non-finite component are left out. Components become floor(scale * x), in
    whole numbers from there on. Vectors of differing length are read as if filled up with zeros to the longest one,
    rounded up to a multiple of ``parts``. Rows that repeat an id or a vector are coded each by itself; null ids are
    coded, too, and count as the largest. Null labels share one ``label_error``. No rows give no rows. Distances have to
    fit into 64 bits: larger components raise an error. Other columns are ignored.

    Every task compares its own vectors with the codebooks (``entries`` vectors) and adds up its own sums; vectors are
    never shuffled, so neither a frequent vector nor a frequent label makes a task larger.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair names at most 256 entries")
    cells = materialize(whole_numbers(df, vector_col, id_col, label_col, scale), "vector-cells")
    seen = cells.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max(F.transform("x", F.abs))).alias("largest")).first()
    width = -(-max(1, seen.width or 0) // parts) * parts
    each = width // parts
    if 4 * (seen.largest or 0) ** 2 * each * (1 << (each - 1).bit_length()) >= 1 << 63:
        raise ValueError(f"components up to {seen.largest} / {scale}: squared distances don't fit into 64 bits")
    books = fit_codebooks(cells, width, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(encode(cells, books), "vector-codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
