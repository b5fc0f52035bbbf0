"""Phrase collocations by SON partitioning (Savasere, Omiecinski, Navathe 1995), level by level.

The corpus is kept as files of word numbers, some MB of text each, and cut into shards of files with about
``SHARD_WORDS`` words together, which is what a task holds of one level. For phrases of one word, then two, up to ``longest``:

* each shard is mined completely at its local support: more than half of the global one's share in proportion to the
  shard's words of a language. It reports what its locally frequent phrases have beyond that half;
* a phrase that is not reported has at most that half in a shard, so one that reaches the support in sum has reports that
  make up the rest. Reports are added up by hash in a bitmap, and what makes up the rest is a candidate: few phrases that
  do not reach the support do, however many shards there are and however low their supports;
* each task counts all candidates that its shards hold, one row for each, and the sums over tasks by hash are exact. What
  reaches the support is frequent, and one of the shards that hold it spells it.

A phrase is looked at only where both its parts of one word less are frequent, for which a bitmap of hashes will do.
Both bitmaps have at most ``MOST_BITS`` bits whatever the corpus; hashes that meet by chance let more phrases be
counted and change no count. With so many shards that a local support is one, everything that the level below leaves
is reported, some bytes for each phrase of a shard, and the candidates are the frequent phrases. Shards that hold rows of
several languages mine each with a support of its own. The tasks that count are as many as the session has cores, so that
their rows follow the number of candidates, not of shards.

Scores are exact: products are decimals of up to 38 digits. A candidate that lies inside a longer one of the same
count lies inside one longer by one word of that count, too, so only these are compared.

Defined results: NULL texts are empty; a NULL language is ``other``; repeated rows count again; phrases are told apart by a hash of
64 bits; a phrase never
crosses ``BREAKS`` or documents; ties of scores go by count, then words in byte order; tables with no frequent phrase
or no row at all give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from abundix.llm import files
from abundix.llm.chunks import pieces
from abundix.llm.running import running_totals
from abundix.llm.skew import with_facts
from abundix.llm.words import Words, mix64, release, small_batches, text_buffer
from abundix.session import cut_lineage

# What ends a piece, and what parts the words in it.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

FILE_BYTES = 16 << 20
SHARD_WORDS = 8_000_000
SLICE_BYTES = 1 << 20
MOST_BITS = 27
SEGMENTS = 6
FULL = (1 << 16) - 1
MOST_HELD = 1 << 21
TOP_SALTS = 64
_STEP = np.uint64(0xD1342543DE82EF95)
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_SOLID = ~_BREAK
_SOLID[list(BLANKS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slice_words(column: pa.Array) -> Iterator[tuple[Words, np.ndarray]]:
    """Lower-case words of slices of whole texts, and which of them begin a piece."""
    data, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1
        last = min(max(last, first + 1), rows)
        part, own = _LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first]
        solid = np.zeros(len(part) + 2, dtype=bool)
        solid[1:-1] = _SOLID[part]
        border = np.zeros(len(part) + 1, dtype=bool)
        border[own] = True
        starts = np.flatnonzero(solid[1:] & (~solid[:-1] | border))
        ends = np.flatnonzero(solid[:-1] & (~solid[1:] | border))
        bounds = np.searchsorted(starts, own)
        passed = np.concatenate([[0], np.cumsum(_BREAK[part])])
        opens = np.ones(len(starts), dtype=bool)
        opens[1:] = passed[starts[1:]] > passed[ends[:-1]]
        opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
        yield Words(first, last, part, own, starts, ends, bounds), opens
        first = last


def language_hash(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


def write_shard(name: str, table: pa.Table) -> dict[str, int]:
    """The shard's file: distinct (language, word), and the text as their numbers with 0 before each piece. Returns words by language."""
    langs = pc.dictionary_encode(table.column("__lang").combine_chunks())
    names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    salt = np.array([language_hash(n) for n in names], dtype=np.uint64)
    hashes, speech, opens, held = [], [], [], []
    for words, begin in slice_words(table.column("__text").combine_chunks()):
        own = of_row[words.first + words.row]
        hashes.append(mix64(words.hashes() ^ salt[own]))
        speech.append(own)
        opens.append(begin)
        held.append(words)
    keys, speech, opens = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (speech, np.int64), (opens, bool)))
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    first = first[order]
    spelled, at = [], 0
    for words in held:
        n = len(words.starts)
        low, high = np.searchsorted(first, [at, at + n])
        spelled.append(words.some(first[low:high] - at))
        at += n
    tokens = np.zeros(len(keys) + int(opens.sum()), dtype=np.int32)
    tokens[np.arange(len(keys)) + np.cumsum(opens)] = rank[number]
    schema = pa.schema([("words", pa.list_(pa.binary())), ("hashes", pa.list_(pa.uint64())), ("langs", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("tokens", pa.list_(pa.int32()))])
    columns = [pa.concat_arrays(spelled) if spelled else pa.array([], pa.binary()), pa.array(distinct[order]), pa.array(speech[first].astype(np.int32)), pa.array(names, pa.string()), pa.array(tokens)]
    row = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
    with files.create(name) as out, pa.ipc.new_file(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as sink:
        sink.write_batch(pa.RecordBatch.from_arrays(row, schema=schema))
    return {n: int(c) for n, c in zip(names, np.bincount(speech, minlength=len(names)).tolist()) if c}


@dataclass
class Shard:
    words: pa.Array
    hashes: np.ndarray
    langs: np.ndarray
    names: list[str]
    tokens: np.ndarray


def open_shard(name: str) -> Shard:
    """Numbers count from 1, so everything by number has a first item that stands for a break."""
    batch = pa.ipc.open_file(files.read(name)).get_batch(0)
    flat = {c: batch.column(c).flatten() for c in batch.schema.names}
    before = lambda values, kind: np.concatenate([np.zeros(1, kind), values.to_numpy()])
    words = pa.concat_arrays([pa.array([b""], pa.binary()), flat["words"]])
    return Shard(words, before(flat["hashes"], np.uint64), before(flat["langs"], np.int32), flat["names"].to_pylist(), flat["tokens"].to_numpy())


def known(hashes: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def phrases(shard: Shard, level: int, frequent: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases of ``level`` words whose parts of one word less may be frequent."""
    tokens = shard.tokens
    own = shard.hashes[tokens]
    at = np.flatnonzero(tokens)
    here = own
    for n in range(2, level + 1):
        ok = np.zeros(len(tokens) + 1, dtype=bool)
        ok[at] = known(here[at], frequent, bits)
        at = np.flatnonzero(ok[:-1] & ok[1:])
        longer = np.zeros(len(tokens), dtype=np.uint64)
        longer[at] = mix64(here[at] * _STEP + own[at + n - 1], n)
        here = longer
    return at, here[at]


def spell(shard: Shard, at: np.ndarray, level: int) -> pa.Array:
    each = [shard.words.take(pa.array(shard.tokens[at + i])) for i in range(level)]
    return each[0] if level == 1 else pc.binary_join_element_wise(*each, b" ")


SEGMENT = "segment int, places binary, shares binary"


def segments(places: np.ndarray, shares: np.ndarray, bits: int) -> pa.RecordBatch:
    """Places of a bitmap as rows (segment, packed places, packed shares); shares of a place add up, to ``FULL`` at most."""
    places, which = np.unique(places, return_inverse=True)
    shares = np.minimum(np.bincount(which, shares, len(places)), FULL).astype(np.uint16)
    width = bits - SEGMENTS
    cuts = np.searchsorted(places, np.arange((1 << SEGMENTS) + 1) << width)
    used = np.flatnonzero(np.diff(cuts)).tolist()
    low = (places & ((1 << width) - 1)).astype(np.uint32)
    packed = [pa.array([x[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()) for x in (low, shares)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *packed], names=["segment", "places", "shares"])


def bitmap_of(rows: DataFrame, bits: int) -> np.ndarray:
    """The places whose shares reach ``FULL`` in rows of ``segments``. Each segment is built in one stream; its bits come to the driver compressed."""
    width = bits - SEGMENTS

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << width, dtype=np.uint32)
        for batch in batches:
            for places, shares in zip(batch.column("places").to_pylist(), batch.column("shares").to_pylist()):
                at = np.frombuffer(places, dtype=np.uint32)
                own[at] = np.minimum(own[at] + np.frombuffer(shares, dtype=np.uint16), FULL)
        data = zlib.compress(np.packbits(own == FULL, bitorder="little").tobytes(), 1)
        yield pa.RecordBatch.from_pydict({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([data], pa.binary())})

    out = np.zeros(1 << (bits - 3), dtype=np.uint8)
    for row in rows.groupBy("segment").applyInArrow(build, "segment int, bits binary").collect():
        low = row["segment"] << (width - 3)
        out[low : low + (1 << (width - 3))] = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return out


def places_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of keys that several files hold, told by the first of these.

    ``found`` has (keys, places, counts) of each file, keys distinct; the result has (which of them, counts in sum).
    """
    keys = np.concatenate([k for k, _, _ in found])
    counts = np.concatenate([c for _, _, c in found])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts[order], starts) if len(keys) else counts
    first = order[starts]
    back = np.argsort(first)
    first, sums = first[back], sums[back]
    bounds = np.cumsum([0, *[len(k) for k, _, _ in found]])
    cuts = np.searchsorted(first, bounds)
    return [(first[lo:hi] - at, sums[lo:hi]) for lo, hi, at in zip(cuts, cuts[1:], bounds)]


def summed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, numbers) of several shards as one, keys distinct: the sum of the counts, the largest number."""
    keys, counts, numbers = (np.concatenate(x) for x in zip(*held))
    if len(keys) == 0:
        return keys, counts, numbers
    order = np.argsort(keys, kind="stable")
    keys, counts, numbers = keys[order], counts[order], numbers[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts), np.maximum.reduceat(numbers, starts)


def shard_phrases(
    names: list[str], level: int, frequent: np.ndarray, wanted: np.ndarray | None, bits: int
) -> Iterator[tuple[Shard, np.ndarray, np.ndarray, np.ndarray]]:
    """(words of a file, hashes, places, counts) of the distinct phrases of a shard that ``wanted`` lets through.

    Every phrase of a shard comes once, with the file that holds it first and its count in the whole shard.
    """
    held, found = [open_shard(name) for name in names], []
    for shard in held:
        at, hashes = phrases(shard, level, frequent, bits)
        if wanted is not None:
            own = known(hashes, wanted, bits)
            at, hashes = at[own], hashes[own]
        keys, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        found.append((keys, at[first], counts.astype(np.int64)))
    for shard, (keys, at, _), (which, counts) in zip(held, found, merged(found)):
        yield shard, keys[which], at[which], counts


class Corpus:
    """The shards of a table, their supports, and the passes over them."""

    def __init__(self, docs: DataFrame, lang: str, text: str, support: int, other: str, file_bytes: int, shard_words: int):
        spark = docs.sparkSession
        small_batches(spark)
        self.spark, self.support = spark, support
        folder = files.new_folder(spark, "shards")
        rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(other)).alias("__lang"), F.col(text).alias("__text"))

        def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in pieces(batches, "__text", file_bytes):
                name = files.new_name(folder, "words", ".arrow")
                found = write_shard(name, table)
                yield pa.RecordBatch.from_pydict(
                    {"file": [name] * len(found), "lang": list(found), "n": pa.array(list(found.values()), pa.int64())},
                    schema=pa.schema([("file", pa.string()), ("lang", pa.string()), ("n", pa.int64())]),
                )
            release()

        manifest = cut_lineage(rows.mapInArrow(stage, "file string, lang string, n long"))
        self.sizes = cut_lineage(manifest.groupBy("lang").agg(F.sum("n").alias("n")))
        whole = self.sizes.agg(F.sum("n")).first()[0] or 0
        self.bits = min(MOST_BITS, max(16, (2 * whole).bit_length()))
        # files in line; where another ``shard_words`` words have gone by, a new shard begins
        line, _ = running_totals(manifest.groupBy("file").agg(F.sum("n").alias("words")), [F.col("file")], {"before": "words"})
        line = cut_lineage(line.select("file", F.floor(F.col("before") / shard_words).cast("long").alias("shard")))
        owned = manifest.join(line, "file").groupBy("shard", "lang").agg(F.sum("n").alias("own"))
        # a phrase that a shard does not report has at most ``spare`` there; what all shards' spares leave of the support must be reported
        owned = owned.join(self.sizes, "lang").select("shard", "lang", F.expr(f"({int(support)}L * own) div (2L * n)").alias("spare"))
        owned = cut_lineage(owned)
        rest = owned.groupBy("lang").agg((F.lit(int(support)) - F.sum("spare")).alias("need"))
        supports = owned.join(rest, "lang").select("shard", "lang", (F.col("spare") + 1).alias("local"), "need")
        by_lang = [F.map_from_entries(F.collect_list(F.struct("lang", c))).alias(c) for c in ("local", "need")]
        supports = supports.groupBy("shard").agg(*by_lang)
        shards = cut_lineage(line.groupBy("shard").agg(F.sort_array(F.collect_list("file")).alias("files")).join(supports, "shard"))
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.shards = cut_lineage(shards.repartition(parts))
        # fewer tasks than shards: a task adds up what its shards count
        self.groups = cut_lineage(shards.select("shard", "files").repartition(min(parts, spark.sparkContext.defaultParallelism)))
        self.count = (line.agg(F.max("shard")).first()[0] or 0) + 1
        self.frequent = np.zeros(1 << (self.bits - 3), dtype=np.uint8)

    def candidates(self, level: int, frequent: Broadcast) -> np.ndarray:
        """Bitmap of the phrases of ``level`` words whose reports make up what the support needs: all frequent ones, and few others."""
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for names, local, need in zip(*(batch.column(c).to_pylist() for c in ("files", "local", "need"))):
                    local, need = dict(local), dict(need)
                    for shard, keys, at, counts in shard_phrases(names, level, frequent.value, None, bits):
                        own = shard.langs[shard.tokens[at]]
                        beyond = counts - np.array([local.get(n, 1) - 1 for n in shard.names], dtype=np.int64)[own]
                        told = np.flatnonzero(beyond > 0)
                        least = np.array([need.get(n, 1) for n in shard.names], dtype=np.int64)[own[told]]
                        shares = -(-np.minimum(beyond[told], least) * FULL // least)  # rounded up
                        for low in range(0, len(told), 1 << 16):
                            cut = slice(low, low + (1 << 16))
                            yield segments(places_of(keys[told[cut]], bits), shares[cut], bits)
            release()

        return bitmap_of(self.shards.mapInArrow(run, SEGMENT), bits)

    def partial(self, level: int, frequent: Broadcast, wanted: Broadcast) -> DataFrame:
        """Rows (hash, packed): how often the shards of a task hold a candidate, and one of the shards that do.

        A row carries count and shard in one number: the count below, above it the shard's number turned by the hash, so
        that the largest is any of the holders with equal chance. A task with more than ``MOST_HELD`` candidates gives
        rows before it has seen all its shards.
        """
        shards, bits = self.count, self.bits

        def rows(keys: np.ndarray, counts: np.ndarray, turned: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(keys), 1 << 16):
                cut = slice(low, low + (1 << 16))
                packed = (turned[cut] << 36) | counts[cut]
                yield pa.RecordBatch.from_arrays([pa.array(keys[cut].view(np.int64)), pa.array(packed)], names=["hash", "packed"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                for names, number in zip(*(batch.column(c).to_pylist() for c in ("files", "shard"))):
                    for _, keys, _, counts in shard_phrases(names, level, frequent.value, wanted.value, bits):
                        turned = ((np.uint64(number) + keys) % np.uint64(shards)).astype(np.int64)
                        held.append((keys, counts, turned))
                        size += len(keys)
                        if size > MOST_HELD:
                            held = [summed(held)]
                            size = len(held[0][0])
                            if size > MOST_HELD // 2:
                                yield from rows(*held[0])
                                held, size = [], 0
            if held:
                yield from rows(*summed(held))
            release()

        return self.groups.mapInArrow(run, "hash long, packed long")

    def sums(self, level: int, frequent: Broadcast, wanted: Broadcast) -> DataFrame:
        """Exact counts (hash, f) of the candidates that reach the support, and one of the shards that hold each."""
        rows = self.partial(level, frequent, wanted)
        below = F.col("packed").bitwiseAND(F.lit((1 << 36) - 1))
        sums = rows.groupBy("hash").agg(F.sum(below).alias("f"), F.max(F.shiftright("packed", 36)).alias("turned"))
        return cut_lineage(sums.where(F.col("f") >= self.support))

    @property
    def places(self):
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places = places_of(batch.column("hash").to_numpy().view(np.uint64), bits)
                yield segments(places, np.full(len(places), FULL), bits)

        return run

    def counted(self, level: int, frequent: Broadcast, wanted: Broadcast) -> DataFrame:
        """Frequent phrases (lang, phrase, words, f, hash): each is spelled once, by a shard that holds it."""
        shards, bits = self.count, self.bits
        found = self.sums(level, frequent, wanted)
        # the number of the shard is (turned - hash) mod shards, with the hash unsigned
        unsigned = F.pmod(F.pmod(F.col("hash"), F.lit(shards)) + F.when(F.col("hash") < 0, F.lit(2**64 % shards)).otherwise(F.lit(0)), F.lit(shards))
        told = found.select("hash", "f", F.pmod(F.col("turned") - unsigned, F.lit(shards)).alias("shard"))
        told = told.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("hash", "f"))).alias("told"))
        work = self.shards.select("shard", "files").join(told, "shard").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, names in enumerate(batch.column("files").to_pylist()):
                    flat = batch.column("told")[i].values
                    keys, sums = flat.field("hash").to_numpy(), flat.field("f").to_numpy()
                    left = np.ones(len(keys), dtype=bool)
                    for name in names:
                        shard = open_shard(name)
                        at, hashes = phrases(shard, level, frequent.value, bits)
                        own, first = np.unique(hashes.view(np.int64), return_index=True)
                        place = np.searchsorted(keys, own)
                        place[place == len(keys)] = 0
                        met = (keys[place] == own) & left[place]
                        place, at = place[met], at[first[met]]
                        left[place] = False
                        for low in range(0, len(at), 1 << 16):
                            cut = slice(low, low + (1 << 16))
                            langs = pa.array(shard.names, pa.string()).take(pa.array(shard.langs[shard.tokens[at[cut]]]))
                            yield pa.RecordBatch.from_arrays(
                                [langs, spell(shard, at[cut], level), pa.array(sums[place[cut]]), pa.array(keys[place[cut]])],
                                names=["lang", "phrase", "f", "hash"],
                            )
            release()

        rows = work.mapInArrow(run, "lang string, phrase binary, f long, hash long")
        return cut_lineage(rows.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(level).alias("words"), "f", "hash"))

    def add(self, found: DataFrame) -> bool:
        """Frequent phrases join the bitmap of frequent ones; whether there were any."""
        here = bitmap_of(found.select("hash").mapInArrow(self.places, SEGMENT), self.bits)
        self.frequent |= here
        return bool(here.any())


def frequent_phrases(
    docs: DataFrame, *, lang: str = "lang", text: str = "text", support: int = 100, longest: int = 5, other: str = "und",
    file_bytes: int = FILE_BYTES, shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words that occur ``support`` times or more: (lang, phrase, words, f, hash); and (lang, n)."""
    corpus = Corpus(docs, lang, text, support, other, file_bytes, shard_words)
    found = None
    for level in range(1, longest + 1):
        frequent = corpus.spark.sparkContext.broadcast(corpus.frequent)
        wanted = corpus.spark.sparkContext.broadcast(corpus.candidates(level, frequent))
        here = corpus.counted(level, frequent, wanted)
        found = here if found is None else found.unionByName(here)
        if not corpus.add(here):
            break
        for used in (frequent, wanted):
            used.unpersist()
    return found, corpus.sizes


def scored(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates of two words or more with their weakest cut: (lang, phrase, words, a, l, r, n, score, hash)."""
    whole = with_facts(
        found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), "hash"), sizes.withColumn("__rows", F.col("n")), ["lang"], "__rows", F.col("hash")
    )
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumn("first", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("rest", F.expr("substring(phrase, char_length(first) + 2)"))
    part = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    exact = "(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    cut = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    best = cuts.groupBy("lang", "phrase", "words", "a", "n", "hash").agg(cut)
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score", "hash")


def collocations(docs: DataFrame, *, top: int = 2000, **more) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, sizes = frequent_phrases(docs, **more)
    own = scored(found, sizes)
    # the two parts of a longer candidate that have one word less; its count is theirs only if they occur nowhere else
    inside = found.where("words > 2").select(
        "lang",
        F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, char_length(substring_index(phrase, ' ', 1)) + 2)"))).alias("phrase"),
        F.col("f").alias("a"),
    )
    left = own.join(inside, ["lang", "phrase", "a"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = left.withColumn("part", F.pmod("hash", F.lit(TOP_SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    placed, _ = running_totals(some.withColumn("one", F.lit(1)), [F.col("lang"), *order], {"before": "one"})
    placed = cut_lineage(placed.select("lang", "phrase", "a", "l", "r", "n", "score", "hash", "before"))
    begin = cut_lineage(placed.groupBy("lang").agg(F.min("before").alias("first"), F.count(F.lit(1)).alias("__rows")))
    ranked = with_facts(placed, begin, ["lang"], "__rows", F.col("hash")).withColumn("rank", F.col("before") - F.col("first") + 1)
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
