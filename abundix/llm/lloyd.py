"""Vector codes by product quantisation; the codebooks come from Lloyd rounds whose members stay where they are.

Vectors of integers floor(scale * x) are cut into parts. Every part position has a codebook of its own, so a part is
a member of (position, entry), and members are dealt to owners (position, entry, salt). An owner sums its resident
members, these sums make the next codebooks, and then it assigns its members anew: those whose entry stays the same
stay in the owner's partition, only those that change their entry go through the shuffle to their next owner. Both
meet there without moving the residents, as the union of two RDDs with one partitioner is narrow. That control over
where rows stay is why this is RDD code; what it moves are packed blocks of members, never rows one by one.

Salts split an entry that holds most members over all partitions. What comes to the driver are the sums of each entry
(parts * entries rows) and the first ``entries`` vectors. The last assignment needs only the final codebooks, so each
vector gets its code where its row is read. All arithmetic is exact: floats only where every product stays below
2**53, else 64-bit integers, else Python's.

Defined results: rows whose vector is NULL or holds NULL, NaN or infinite components are dropped, and so are those
whose vector has another length than that of the first row by key, as their parts cannot be compared; a NULL key
comes last in the order of keys, equal keys follow their vectors; repeated rows all take part; with fewer rows than
entries the codebook has as many entries as rows; lengths that the parts do not divide are cut as evenly as
possible; empty vectors have code 0 and error 0; an error beyond 64 bits is NULL, and so is the sum of its label; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundix.llm.skew import with_facts
from abundix.session import cut_lineage

MEMBERS = 1 << 15
Block = tuple[int, str, bytes]


@dataclass(frozen=True)
class Shape:
    """How vectors are cut and where their members live. ``bounds`` are the first components of the parts, and the length."""

    bounds: tuple[int, ...]
    entries: int
    scale: int
    salts: int

    @property
    def parts(self) -> int:
        return len(self.bounds) - 1

    def owner(self, part: int, entry: int, salt: int) -> int:
        """Owners of one entry have consecutive numbers, so that even a single one spreads over all partitions."""
        return (entry * self.salts + salt) * self.parts + part

    def place(self, owner: int) -> tuple[int, int, int]:
        part, rest = owner % self.parts, owner // self.parts
        return part, rest // self.salts, rest % self.salts

    def width(self, part: int) -> int:
        return self.bounds[part + 1] - self.bounds[part]


def usable(vector: Column) -> Column:
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & whole


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite floats, as Python integers where 64 bits may not hold them."""
    if len(values) == 0 or scale * np.abs(values).max() < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    exact = [int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in values.tolist()]
    return np.array(exact, dtype=object)


def vectors(column: pa.Array, scale: int) -> np.ndarray:
    """Matrix of the integer vectors of an Arrow list column, all of one length."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return integers(flat, scale).reshape(len(column), -1)


def pack(members: np.ndarray) -> Block:
    """(number, type, bytes), in the narrowest type that holds them."""
    if members.dtype == object:
        return len(members), "o", pickle.dumps(members.tolist())
    top = int(np.abs(members).max(initial=0))
    kind = "h" if top < 2**15 else "i" if top < 2**31 else "q"
    return len(members), kind, members.astype(kind).tobytes()


def unpack(block: Block, width: int) -> np.ndarray:
    number, kind, data = block
    if kind == "o":
        return np.array(pickle.loads(data), dtype=object).reshape(number, width)
    return np.frombuffer(data, dtype=kind).astype(np.int64).reshape(number, width)


def together(blocks: list[np.ndarray]) -> np.ndarray:
    if any(b.dtype == object for b in blocks):
        blocks = [b.astype(object) for b in blocks]
    return np.concatenate(blocks)


def nearest(members: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each member, the first of equal ones, and its squared distance."""
    width = members.shape[1]
    top = max([int(np.abs(members).max(initial=0)), *(abs(c) for entry in book for c in entry)])
    bound = (2 * top) ** 2 * max(width, 1)
    if bound < 2**53:
        x, c = members.astype(np.float64), np.array(book, dtype=np.float64).reshape(len(book), width)
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
        best = far.argmin(axis=1)
        return best, far[np.arange(len(best)), best].astype(np.int64)
    kind = np.int64 if bound < 2**63 else object
    x = members.astype(kind)
    far = np.stack([((x - np.array(entry, dtype=kind)) ** 2).sum(axis=1) for entry in book], axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(best)), best]


def first_members(df: DataFrame, shape: Shape, books: list[list[list[int]]]) -> RDD:
    """(owner, block) of all parts, each with the nearest entry of the first codebooks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        turn = 0

        def block(part: int, entry: int) -> pa.RecordBatch:
            nonlocal turn
            number, kind, data = pack(together(held.pop((part, entry))))
            salt = (zlib.crc32(data) + turn) % shape.salts
            turn += 1
            return pa.RecordBatch.from_pydict(
                {"owner": pa.array([shape.owner(part, entry, salt)]), "n": pa.array([number]), "kind": [kind], "data": pa.array([data], pa.binary())}
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = vectors(batch.column(0), shape.scale)
            for part in range(shape.parts):
                own = whole[:, shape.bounds[part] : shape.bounds[part + 1]]
                best, _ = nearest(own, books[part])
                for entry in np.unique(best).tolist():
                    held.setdefault((part, entry), []).append(own[best == entry])
                    if sum(map(len, held[part, entry])) >= MEMBERS:
                        yield block(part, entry)
        for part, entry in sorted(held):
            yield block(part, entry)

    blocks = df.mapInArrow(deal, "owner long, n long, kind string, data binary")
    return blocks.rdd.map(lambda r: (r["owner"], (r["n"], r["kind"], bytes(r["data"]))))


def gathered(blocks: Iterator[tuple[int, Block]], shape: Shape) -> Iterator[tuple[int, np.ndarray]]:
    """An owner's blocks together, at most about ``MEMBERS`` members at a time."""
    held: dict[int, list[np.ndarray]] = {}
    for owner, block in blocks:
        held.setdefault(owner, []).append(unpack(block, shape.width(shape.place(owner)[0])))
        if sum(map(len, held[owner])) >= MEMBERS:
            yield owner, together(held.pop(owner))
    for owner, members in held.items():
        yield owner, together(members)


def resident_sums(residents: RDD, shape: Shape) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to number and sum of members: owners first, then one small table at the driver."""

    def own(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[tuple[int, int], tuple[int, list[int]]]]:
        sums: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for owner, members in gathered(blocks, shape):
            part, entry, _ = shape.place(owner)
            safe = members if len(members) * int(np.abs(members).max(initial=0)) < 2**62 else members.astype(object)
            here = (len(members), [int(x) for x in safe.sum(axis=0)])
            sums[part, entry] = plus(sums[part, entry], here) if (part, entry) in sums else here
        yield from sums.items()

    return residents.mapPartitions(own).reduceByKey(plus, 8).collectAsMap()


def plus(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]


def reassigned(residents: RDD, shape: Shape, books: list[list[list[int]]]) -> RDD:
    """(owner, (next owner or None, block)) of all residents: None for those that stay."""

    def assign(blocks: Iterator[tuple[int, Block]]) -> Iterator[tuple[int, tuple[int | None, Block]]]:
        for owner, members in gathered(blocks, shape):
            part, entry, salt = shape.place(owner)
            best, _ = nearest(members, books[part])
            for new in np.unique(best).tolist():
                block = pack(members[best == new])
                yield owner, (None if new == entry else shape.owner(part, new, salt), block)

    return residents.mapPartitions(assign, preservesPartitioning=True)


def fit(df: DataFrame, first: list[list[int]], shape: Shape, rounds: int) -> list[list[list[int]]]:
    """The codebooks after ``rounds`` rounds: books[part][entry] are its components. ``df`` has the vectors only."""
    books = [[list(v[shape.bounds[p] : shape.bounds[p + 1]]) for v in first] for p in range(shape.parts)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def by_owner(owner: int) -> int:
        return owner

    residents = first_members(df, shape, books).partitionBy(parts, by_owner)
    held: list[RDD] = []
    for turn in range(rounds):
        for (part, entry), (number, sums) in resident_sums(residents, shape).items():
            books[part][entry] = [s // number for s in sums]
        for old in held[:-1]:
            old.unpersist()
        if turn + 1 == rounds:
            break
        assigned = reassigned(residents, shape, [[list(e) for e in book] for book in books]).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(assigned)
        stay = assigned.mapPartitions(lambda rows: ((owner, block) for owner, (new, block) in rows if new is None), preservesPartitioning=True)
        move = assigned.mapPartitions(lambda rows: ((new, block) for _, (new, block) in rows if new is not None))
        residents = stay.union(move.partitionBy(parts, by_owner))
    for old in held:
        old.unpersist()
    return books


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()


def coded(df: DataFrame, shape: Shape, books: list[list[list[int]]]) -> DataFrame:
    """Adds ``code`` and ``error`` in place of the last column, the vector."""
    names = df.columns[:-1]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            whole = vectors(batch.column(len(names)), shape.scale)
            code, error = np.full(len(whole), "", dtype=object), np.zeros(len(whole), dtype=object)
            for part in range(shape.parts):
                best, far = nearest(whole[:, shape.bounds[part] : shape.bounds[part + 1]], books[part])
                code = code + digits[best].astype(object)
                error = error + far.astype(object)
            errors = [int(e) if e < 2**63 else None for e in error.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code.tolist(), pa.string()), pa.array(errors, pa.int64())], names=[*names, "code", "error"])

    return df.mapInArrow(encode, df.drop(df.columns[-1]).schema.add("code", "string").add("error", "long"))


def vector_codes(
    df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> DataFrame:
    """Per kept row: key, label, ``code`` (two hex digits a part), ``error``, ``label_error``, ``codebooks_sha256``."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so at most 256 entries")
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("__key"), F.col(label).alias("__label"), F.col(vector).alias("__vector")).where(usable(F.col("__vector")))
    start = rows.orderBy(F.col("__key").asc_nulls_last(), "__vector").limit(1).collect()
    size = len(start[0]["__vector"]) if start else 0
    rows = rows.where(F.size("__vector") == size)
    first = [r["__vector"] for r in rows.orderBy(F.col("__key").asc_nulls_last(), "__vector").limit(entries).collect()]
    first = [[int(x) for x in integers(np.array(v, dtype=np.float64), scale)] for v in first]
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    shape = Shape(tuple(size * p // parts for p in range(parts + 1)), max(1, len(first)), scale, salts)
    books = fit(rows.select("__vector"), first, shape, rounds) if first else []

    done = coded(rows, shape, books).withColumns({"__is": F.col("__label").isNull(), "__of": F.coalesce(F.col("__label").cast("string"), F.lit(""))})
    done = cut_lineage(done)
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(19,0)")))
    sums = done.groupBy("__is", "__of").agg(whole.alias("__sum"), F.count(F.lit(1)).alias("__rows"))
    done = with_facts(done, cut_lineage(sums), ["__is", "__of"], "__rows", F.hash("__key", "code", "error"))
    total = F.when(F.col("__sum") < F.lit(str(2**63)).cast("decimal(19,0)"), F.col("__sum").cast("long"))
    return done.select(
        F.col("__key").alias(key),
        F.col("__label").alias(label),
        "code",
        "error",
        total.alias("label_error"),
        F.lit(digest(books)).alias("codebooks_sha256"),
    )
