"""Vector code compression: product quantisation with exact integer arithmetic.

Components become integers floor(256 * x). A vector is cut into equal parts, and each part is replaced by the
index of the nearest entry of that part's codebook. To find it, entries are filtered from coarse to fine by
segment means: with the part cut into segments, the squared distance of a part x and an entry c is the sum over
segments of length * (mean(x) - mean(c))**2, plus the squared distance of the two residuals (what is left
without the means), which is at least (|residual(x)| - |residual(c)|)**2. Level 0 has one segment, each
further level halves them. An entry whose bound is above the distance of the entry that looks best goes; bounds
are floating-point numbers with a margin above their rounding error, so no nearest entry is ever lost. The
entries that survive all levels get exact integer distances; ties go to the lower index.

Learning reads the whole table once a round: tasks add up the parts of each entry, sums meet by entry.
Only codebooks (entries x components) pass through the driver; their size does not depend on the input.

Defined cases: rows whose vector is null or has a null, NaN or infinite component are dropped. Null ids come after
all others; rows that repeat an id are vectors of their own, in the order of their components. With fewer vectors
than entries a codebook has as many entries as there are vectors. Integers have no upper bound: components too
large for 64 bits are computed with Python's integers, and an error that does not fit into a long is null. The length
of the first vector is the table's; a vector of another length is kept with null code and error. A length
that the number of parts does not divide is an error. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors compared at once; with 64 entries a table of bounds takes about 2 MB.
BATCH = 4096
#: Entries of a part whose distance is looked at on each level to lower the limit for the others.
PROBES = 4
#: Above this a component, squared and summed over a part, may not fit into 64 bits.
NARROW = 1 << 26
LIMB = 32


def _integer(x: float) -> int:
    """floor(256 * x) of any finite number."""
    return int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)


def _integers(values: np.ndarray) -> np.ndarray:
    """Rows of floor(256 * x): 64-bit integers, or Python's where any is too large."""
    if not values.size or np.abs(values).max() < NARROW / SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    whole = np.empty(values.shape, object)
    whole.flat = [_integer(x) for x in values.ravel().tolist()]
    return whole


def _floats(whole: np.ndarray, shift: int) -> np.ndarray:
    """Integers over 2**shift as floating-point numbers."""
    if whole.dtype != object:
        return whole.astype(np.float64) / 2.0**shift
    out = np.array([x / (1 << shift) for x in whole.ravel().tolist()], np.float64)
    return out.reshape(whole.shape)


def segment_levels(width: int) -> list[np.ndarray]:
    """Starts of the segments of each level, coarse to fine; segments of the last level have one or two components."""
    levels, n = [], 1
    while n <= max(1, width // 2):
        levels.append(np.unique(np.arange(n) * width // n))
        n *= 2
    return levels


def _summary(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row: segment means, scaled by the root of the length, and the norm of the residual."""
    lengths = np.diff(np.append(starts, values.shape[1]))
    means = np.add.reduceat(values, starts, axis=1) / lengths
    rest = values - np.repeat(means, lengths, axis=1)
    return means * np.sqrt(lengths), np.sqrt((rest * rest).sum(1))


def survivors(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries) of the pairs that no bound excludes, in order; each row has at least its nearest entries."""
    shift = max(0, max(int(np.abs(x).max()), int(np.abs(c).max())).bit_length() - 400)
    fx, fc = _floats(x, shift), _floats(c, shift)
    nx, nc = np.sqrt((fx * fx).sum(1)), np.sqrt((fc * fc).sum(1))
    margin = x.shape[1] * 2.0**-46
    n = np.arange(len(x))
    rows, cols = np.repeat(n, len(c)), np.tile(np.arange(len(c)), len(x))
    most = np.full(len(x), np.inf)
    for starts in segment_levels(x.shape[1]):
        (mx, rx), (mc, rc) = _summary(fx, starts), _summary(fc, starts)
        bound = (rx[rows] - rc[cols]) ** 2
        for i in range(len(starts)):
            bound += (mx[rows, i] - mc[cols, i]) ** 2
        # the entry with the least bound looks best: nothing beyond its distance is needed, which then is its own bound
        first = np.searchsorted(rows, n)
        for _ in range(PROBES):
            hits = np.flatnonzero(bound == np.minimum.reduceat(bound, first)[rows])
            probe = hits[np.searchsorted(rows[hits], n)]
            best = cols[probe]
            far, slack = ((fx - fc[best]) ** 2).sum(1), margin * (nx + nc[best]) ** 2
            most = np.minimum(most, far + slack + 1e-290)
            bound[probe] = np.maximum(bound[probe], far - slack)
        stay = bound <= most[rows] + margin * (nx[rows] + nc[cols]) ** 2
        rows, cols = rows[stay], cols[stay]
    return rows, cols


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest row of ``c`` and their squared distance, exactly. Both hold integers."""
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows, cols = survivors(x, c)
    if x.dtype != object and c.dtype != object:
        exact = ((x[rows] - c[cols]) ** 2).sum(1)
    else:
        exact = np.empty(len(rows), object)
        exact[:] = [sum((int(a) - int(b)) ** 2 for a, b in zip(x[i], c[j], strict=True)) for i, j in zip(rows.tolist(), cols.tolist(), strict=True)]
    least = np.minimum.reduceat(exact, np.searchsorted(rows, np.arange(n)))
    hits = np.flatnonzero(exact == least[rows])
    return cols[hits[np.searchsorted(rows[hits], np.arange(n))]], least


class Codebooks:
    """Entries by part: integers, as an array (parts, entries, components of a part)."""

    def __init__(self, rows: list[list[int]], parts: int = PARTS):
        length = len(rows[0]) if rows else 0
        if length % parts:
            raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
        self.parts, self.length, self.width = parts, length, length // parts
        self.entries = [[row[p * self.width : (p + 1) * self.width] for row in rows] for p in range(parts)]

    def arrays(self) -> list[np.ndarray]:
        wide = any(abs(v) >= NARROW for part in self.entries for entry in part for v in entry)
        return [np.array(part, object if wide else np.int64).reshape(len(part), self.width) for part in self.entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()


def _kept(vectors: DataFrame, key: str, vector: str, label: str | None) -> DataFrame:
    """(vec_id, label, v): the rows whose vector has finite components only, as doubles."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = F.col(label) if label else F.lit(None).cast("int")
    return vectors.filter(F.col(vector).isNotNull() & ~odd).select(F.col(key).alias("vec_id"), own.alias("label"), v.alias("v"))


def _batches(batches, length: int):
    """Arrow batches in slices: the slice, which of its vectors have the right length, and their integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            piece = batch.slice(at, BATCH)
            v = piece.column("v")
            right = np.diff(v.offsets.to_numpy()) == length
            flat = v.flatten().to_numpy(zero_copy_only=False)
            yield piece, right, _integers(flat[np.repeat(right, np.diff(v.offsets.to_numpy()))].reshape(-1, length))


def _part_sums(arrays: list[np.ndarray], length: int):
    """A map over Arrow batches: for each task, sums of the parts assigned to an entry, in limbs of 32 bits, and their counts.

    A row (part, entry, place, limb, value); place -1 holds the count."""
    parts, entries, width = len(arrays), len(arrays[0]), length // len(arrays)

    def add(batches):
        sums = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for _, _, whole in _batches(batches, length):
            for p, book in enumerate(arrays):
                x = whole[:, p * width : (p + 1) * width]
                near, _ = nearest(x, book)
                order = np.argsort(near, kind="stable")
                used, first, n = np.unique(near[order], return_index=True, return_counts=True)
                if len(used):
                    counts[p, used] += n
                    sums[p, used] += np.add.reduceat(x[order], first, axis=0).astype(object)
        found = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        for p, e, _, _, _ in list(found):
            for at, value in enumerate(sums[p, e].tolist()):
                value, limb = int(value), 0
                # all limbs but the last are not negative; the last one has the sign
                while not -(1 << LIMB) < value < (1 << LIMB):
                    found.append((p, e, at, limb, value & ((1 << LIMB) - 1)))
                    value, limb = value >> LIMB, limb + 1
                found.append((p, e, at, limb, value))
        columns = [pa.array([int(r[i]) for r in found], pa.int64() if i == 4 else pa.int32()) for i in range(5)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "place", "limb", "value"])

    return add


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Learn codebooks from rows (vec_id, v): the parts of the first vectors, moved to the means of what they attract, ``rounds`` times."""
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    length = len(first[0]["v"]) if first else 0
    books = Codebooks([[_integer(x) for x in r["v"]] for r in first if len(r["v"]) == length], parts)
    if not length:
        return books
    for _ in range(rounds):
        partial = kept.select("v").mapInArrow(_part_sums(books.arrays(), length), "part int, entry int, place int, limb int, value long")
        # one row for each component of the codebooks and limb
        total = partial.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).collect()
        sums: dict[tuple[int, int], dict[int, int]] = {}
        for r in total:
            at = sums.setdefault((r["part"], r["entry"]), {})
            at[r["place"]] = at.get(r["place"], 0) + (r["value"] << (LIMB * r["limb"]))
        for (p, e), at in sums.items():
            books.entries[p][e] = [at[i] // at[-1] for i in range(books.width)]
    return books


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of rows (vec_id, label, v): ``code`` has a byte for each part, up to 256 entries."""
    arrays, length, width = books.arrays(), books.length, books.width

    def code(batches):
        for piece, right, whole in _batches(batches, length):
            codes = np.zeros((len(whole), len(arrays)), np.uint8)
            error = np.zeros(len(whole), object)
            for p, book in enumerate(arrays):
                near, far = nearest(whole[:, p * width : (p + 1) * width], book)
                codes[:, p] = near
                error += far.astype(object)
            out, errors, at = [None] * len(right), [None] * len(right), np.flatnonzero(right)
            for i, row, e in zip(at.tolist(), codes, error.tolist(), strict=True):
                out[i], errors[i] = row.tobytes(), e if e < 1 << 63 else None
            yield pa.RecordBatch.from_arrays(
                [piece.column("vec_id"), piece.column("label"), pa.array(out, pa.binary()), pa.array(errors, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error long")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", out: str = "vector") -> DataFrame:
    """Add ``out``: the vector of integers that a code stands for. Codebooks with components beyond 64 bits cannot be decoded."""
    table = F.array(*[F.array(*[F.array(*[F.lit(v).cast("long") for v in entry]) for entry in part]) for part in books.entries])
    byte = lambda i: F.conv(F.hex(F.substring(code, i + 1, F.lit(1))), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(books.parts - 1)), lambda i: F.get(F.get(table, i), byte(i)))
    return codes.withColumn(out, F.flatten(parts))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """Codes (vec_id, label, code, error) of all vectors with finite components, and the codebooks they refer to."""
    kept = _kept(vectors, key, vector, label)
    books = fit(kept, parts, entries, rounds)
    return encode(kept, books), books


def report(codes: DataFrame, books: Codebooks) -> DataFrame:
    """Codes in hex, with the error of all vectors of the same label; labels may be hot, so their sums meet the rows by a counted join."""
    named = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    rows = materialise(codes.withColumn("name", named), "codes")
    sums = rows.groupBy("name").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = materialise(sums.select("name", F.expr("try_cast(s AS long)").alias("label_error"), "n"), "label-errors")
    return join_counted(rows, sums, "name").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(*compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _assign_sql(n: int) -> str:
    return f"""
near{n} AS (SELECT x.k, x.p, x.label, x.v, b.e, list_sum(list_transform(x.v, lambda a, i: (a - b.c[i]) * (a - b.c[i])))::HUGEINT AS d
  FROM parts x JOIN book{n} b ON b.p = x.p),
got{n} AS (SELECT k, p, any_value(label) AS label, any_value(v) AS v, min(d) AS d, min_by(e, (d, e)) AS e FROM near{n} GROUP BY k, p)"""


def _update_sql(n: int) -> str:
    return f""",{_assign_sql(n)},
mean{n} AS (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS c
  FROM (SELECT p, e, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM got{n}, range(1, len(v) + 1) AS r(i) GROUP BY p, e, i) GROUP BY p, e),
book{n + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e)"""


SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::HUGEINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT k, label, p::INT AS p, v[(p * len(v) // {PARTS} + 1):((p + 1) * len(v) // {PARTS})] AS v FROM kept, range({PARTS}) AS r(p)),
book0 AS (SELECT p, (k - 1)::INT AS e, v AS c FROM parts WHERE k <= {ENTRIES})
{"".join(_update_sql(n) for n in range(ROUNDS))},{_assign_sql(ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS s FROM book{ROUNDS}),
codes AS (SELECT k, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM got{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256
FROM kept JOIN codes USING (k), sha
"""
