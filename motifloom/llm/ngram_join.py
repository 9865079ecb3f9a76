"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

1. Sieve. Two documents can only link if each has at least the threshold's share of its shingles in the other. From a
   fixed third of the hash space every document's shingles are counted; a document with too many that no other document
   has cannot link to anything and is done. This removes what merely quotes common passages.
2. Equal sets collapse to one class, whichever number of documents has them.
3. Families. Sets with the same least hash under either of two scramblings are compared in blocks of bounded size; the
   links found there join families of near copies early. This step only saves work: what it misses, step 4 finds.
4. Tiles. Every shingle is counted over all classes, and a set's shingles are ordered by that count, rarest first. Of a
   linked pair the smaller set has a shingle among its first n - ceil(2t/(1+t) n) + 1 that the larger one has among its
   first n - ceil(t n) + 1. A tile holds the sets of one size band and of the band below that have such a shingle in
   common; tiles whose sets are all connected already are left out, and large ones are cut into pairs of chunks.
5. A tile's pairs of sets that are not connected yet and whose sizes allow a link are bounded by bit counts of hashed
   bitmaps - each differing bit is a differing shingle, which bounds the overlap from above - and what the bound leaves is
   intersected exactly: first the best pair of every two components, then what is still not connected.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside, body, tidy, written
from .graph import connected_components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
LETTER = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
PLACE = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
SLICE = 2.0**64 / 3  # the sieve's part of the hash space
LOOK_BACK = 4  # shingles before one that its entry in a tile carries
PIECE = 2_000_000  # characters of a text that are shingled at once
SEVERAL = 65_535  # in place of an owner: several of a portion have the shingle
WHITE = "\x20\t\n\v\f\r"
CUT = re.compile(f"[{WHITE}]")
SALTS = (np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x1B873593CC9E2D51))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 2**64)
    up, down = np.full(n, BASE, dtype=np.uint64), np.full(n, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def pieces(text: str, words: int, most: int = PIECE) -> Iterator[str]:
    """A text in pieces of about `most` characters, cut at white space. Each begins with the last words - 1 words of the
    one before, so that every shingle lies in a piece; a text that is cut has at least `words` words in every piece."""
    start = fresh = 0
    reach = most
    while len(text) - start > reach:
        cut = CUT.search(text, start + reach)
        if cut is None:
            break
        back = cut.start()
        for _ in range(words - 1):
            while back > start and text[back - 1] in WHITE:
                back -= 1
            while back > start and text[back - 1] not in WHITE:
                back -= 1
        if text[start:back].strip(WHITE):
            yield text[start : cut.start()]
            start, fresh, reach = back, cut.start(), most
        else:  # very long words
            reach *= 2
    if not fresh or text[fresh:].strip(WHITE):
        yield text[start:]


def shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's distinct shingles as sorted 64-bit hashes, one text after the other.

    Words are runs of non-white-space, A-Z in lower case; a text of fewer than `words` words is one shingle. Long texts
    are shingled piece by piece: the memory above the hashes themselves does not grow with a text.
    """
    if max(map(len, texts), default=0) <= PIECE:
        return _shingle_sets(texts, words)
    sets = [np.unique(np.concatenate([_shingle_sets([p], words)[0] for p in pieces(t, words)])) for t in texts]
    return np.concatenate(sets), np.cumsum([len(x) for x in sets])


def _shingle_sets(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", dtype=np.uint8)
    bounds = np.cumsum([1, *(len(r) + 1 for r in raw)])
    space = SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    up, down = _powers(1 << (len(data) - 1).bit_length())
    prefix = np.cumsum(LETTER[LOWER[data]] * up[: len(data)], dtype=np.uint64)
    word = mix((prefix[stops - 1] - prefix[starts - 1]) * down[starts] + (stops - starts).astype(np.uint64))
    doc = np.searchsorted(bounds, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    total = len(word)
    whole = doc[: max(0, total - words + 1)] == doc[words - 1 :] if total >= words else np.zeros(0, dtype=bool)
    at = np.flatnonzero(whole)
    hashes = np.zeros(len(at), dtype=np.uint64)
    for k in range(words):
        hashes += word[at + k] * PLACE[k]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    first = np.cumsum(n_words) - n_words
    few = [np.uint64((sum(int(word[first[d] + k]) * int(PLACE[k]) for k in range(n_words[d])) + int(n_words[d]) * 0x2545F4914F6CDD1D) % 2**64) for d in short.tolist()]
    hashes, owner = mix(np.concatenate([hashes, np.array(few, dtype=np.uint64)])), np.concatenate([doc[at], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.cumsum(np.bincount(owner, minlength=len(texts)))


def _portions(batches, most: int = 500_000):
    """(ids, texts) in portions of about `most` characters."""
    ids, texts, size = [], [], 0
    for batch in (whole.slice(first, 200) for whole in batches for first in range(0, whole.num_rows, 200)):
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= most or len(ids) >= 60_000:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# ---------------------------------------------------------------- 1. sieve

SIEVE = "batch bigint, bucket int, prints binary, owners binary, times binary, ids array<bigint>, sizes array<bigint>"
_SIEVE = pa.schema(
    [("batch", pa.int64()), ("bucket", pa.int32()), ("prints", pa.binary()), ("owners", pa.binary()), ("times", pa.binary())]
    + [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)
ALONE = "batch bigint, owners binary, counts binary"
_ALONE = pa.schema([("batch", pa.int64()), ("owners", pa.binary()), ("counts", pa.binary())])


def _bucketed(batch: int, ids: list[int], sizes: np.ndarray, hashes: np.ndarray, owner: np.ndarray, buckets: int, keep: bool = False) -> pa.RecordBatch:
    """A portion's shingles by bucket of the hash space: each distinct 32-bit print once, with the place of its owner, or
    SEVERAL and how many times it occurs here. So a shingle that all documents have comes once from a portion. Bucket -1
    has the portion's ids and set sizes, and where `keep`, who has the prints of several (bucket and print, owners)."""
    token = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    fresh = np.ones(len(token), dtype=bool)
    fresh[1:] = token[1:] != token[:-1]
    at = np.flatnonzero(fresh)
    times = np.diff(at, append=len(token))
    row = {"batch": batch, "bucket": -1, "ids": ids, "sizes": sizes.tolist()}
    if keep:
        shared = np.repeat(times > 1, times)
        row |= {"prints": token[shared].astype("<i8").tobytes(), "owners": owner[shared].astype("<u2").tobytes()}
    rows, token, owner = [row], token[at], np.where(times > 1, SEVERAL, owner[at]).astype("<u2")
    held, first = np.unique(token >> 32, return_index=True)
    for b, x, y in zip(held.tolist(), first.tolist(), [*first[1:].tolist(), len(token)], strict=False):
        here = times[x:y]
        rows.append({"batch": batch, "bucket": b, "prints": (token[x:y] & 0xFFFFFFFF).astype("<u4").tobytes(), "owners": owner[x:y].tobytes(), "times": here[here > 1].astype("<u4").tobytes()})
    return pa.RecordBatch.from_pylist(rows, schema=_SIEVE)


def _sieve_rows(batches, words: int, buckets: int):
    base = TaskContext.get().partitionId() << 24
    for nth, (ids, texts) in enumerate(_portions(batches)):
        hashes, ends = shingle_sets(texts, words)
        sizes = np.diff(ends, prepend=0)
        owner = np.repeat(np.arange(len(ids)), sizes)
        inside = hashes < np.uint64(int(SLICE))
        yield _bucketed(base + nth, ids, sizes, mix(hashes[inside]), owner[inside], buckets)


def _groups(batches, name: str):
    """The rows of batches sorted by `name`, one list per value of it; a task holds one value's rows at a time."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[name] != at:
                yield held
                held = []
            at = row[name]
            held.append(row)
    if held:
        yield held


def _sums(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a bucket -> batch, prints, owners, and how often each print occurs in all of them."""
    prints, owners = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("prints", "<u4"), ("owners", "<u2")))
    times = np.ones(len(prints))
    times[owners == SEVERAL] = np.concatenate([np.frombuffer(r["times"], "<u4") for r in rows])
    _, at = np.unique(prints, return_inverse=True)
    sums = np.bincount(at, weights=times)[at].astype(np.int64)
    ends = np.cumsum([len(r["prints"]) // 4 for r in rows])[:-1]
    return zip((r["batch"] for r in rows), np.split(prints, ends), np.split(owners, ends), np.split(sums, ends), strict=True)


def _alone(batches):
    """Per batch and bucket: how many of its documents' prints here no other document has (owners u2, counts u4)."""
    for rows in _groups(batches, "bucket"):
        out = []
        for batch_id, _, owners, sums in _sums(rows):
            n = np.bincount(owners[sums == 1])
            some = np.flatnonzero(n)
            out.append({"batch": batch_id, "owners": some.astype("<u2").tobytes(), "counts": n[some].astype("<u4").tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=_ALONE)


def _by_document(batches):
    """Rows (batch, ids, sizes, owners, counts) -> id, n_shingles, alone: a batch's counts of all buckets, summed."""
    for rows in _groups(batches, "batch"):
        named = next(r for r in rows if r["ids"] is not None)
        alone = np.zeros(len(named["ids"]), dtype=np.int64)
        for r in rows:
            if r["ids"] is None:
                alone[np.frombuffer(r["owners"], "<u2")] += np.frombuffer(r["counts"], "<u4")
        columns = [pa.array(named["ids"], pa.int64()), pa.array(named["sizes"], pa.int64()), pa.array(alone)]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "alone"])


def _n_buckets(spark, total: int, each: int) -> int:
    """How many buckets hold about `each` of `total`, as many as the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total or 0) // each))


def _sieve(docs: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(sizes: id, n_shingles of every row; ids that may link)."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0]
    buckets = _n_buckets(docs.sparkSession, chars, 8_000_000)
    rows = written(docs.mapInArrow(tidy(lambda b: _sieve_rows(b, words, buckets)), SIEVE), "ngram-sieve")
    prints = rows.where("bucket >= 0").select("batch", "bucket", "prints", "owners", "times").repartition(buckets, "bucket")
    alone = prints.sortWithinPartitions("bucket").mapInArrow(tidy(_alone), ALONE)
    parts = rows.where("bucket < 0").select("batch", "ids", "sizes").unionByName(alone, allowMissingColumns=True)
    summed = parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(tidy(_by_document), "id bigint, n_shingles bigint, alone bigint")
    joined = written(summed, "ngram-sizes")
    may = joined.where((F.col("n_shingles") > 0) & (F.col("alone") * den <= F.col("n_shingles") * (den - num)))
    return joined.select("id", "n_shingles"), may.select("id").distinct()


# ---------------------------------------------------------------- 2. classes of equal sets

_SETS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("set", pa.binary())])


def _set_rows(batches, words: int):
    for ids, texts in _portions(batches):
        hashes, ends = shingle_sets(texts, words)
        out, seen, start = [], set(), 0
        for key, end in zip(ids, ends.tolist(), strict=True):
            data = hashes[start:end].tobytes()
            name = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
            out.append({"id": key, "key": name, "n": end - start, "set": None if name in seen else data})
            seen.add(name)
            start = end
        yield pa.RecordBatch.from_pylist(out, schema=_SETS)


# ---------------------------------------------------------------- 3. families: exact comparison in blocks


def bit_width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: two to four a shingle."""
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    """A hashed bitmap as bytes; halves laid over each other give the bitmap of half the width."""
    out = np.zeros(width, dtype=bool)
    out[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """The bitmaps of some sets, all as wide as the largest one needs, as 64-bit words."""
    width = bit_width(max(map(len, sets)))
    return np.stack([bitmap(s, width) for s in sets]).view(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a & b| >= num * |a | b|, by the intersection of two sorted arrays."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return den * both >= num * (len(a) + len(b) - both)


def cluster_links(keys: list[int], sets: list[np.ndarray], asked: list[bool], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect what is connected: a spanning forest of the links that have at least one asked end.

    Sets are visited by size; a set meets the larger ones up to its size limit that it is not yet connected to.
    """
    order = sorted(range(len(keys)), key=lambda i: (len(sets[i]), keys[i]))
    keys, sets, asks = [keys[i] for i in order], [sets[i] for i in order], np.array([asked[i] for i in order])
    size, label, found = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    bits = bitmaps(sets)
    last = np.searchsorted(size, size * den // num, side="right")
    for i in range(len(sets)):
        rest = np.arange(i + 1, last[i])
        rest = rest[(label[rest] != label[i]) & (asks[rest] | asks[i])]
        if not len(rest):
            continue
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1, dtype=np.int64)
        most = (size[rest] + size[i] - differ) // 2
        for j in rest[den * most >= num * (size[rest] + size[i] - most)].tolist():
            if label[j] != label[i] and linked(sets[i], sets[j], num, den):
                found.append((keys[i], keys[j]))
                label[label == label[j]] = label[i]
    return found


def _compare(num: int, den: int):
    """Rows (tile, key, asked, set), sorted by tile -> links."""

    def run(batches):
        tile, keys, sets, asked = None, [], [], []

        def done():
            pairs = np.array(cluster_links(keys, sets, asked, num, den), dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for t, key, ask, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if t != tile:
                    if len(keys) > 1:
                        yield done()
                    tile, keys, sets, asked = t, [], [], []
                keys.append(key)
                sets.append(np.frombuffer(data, dtype=np.uint64))
                asked.append(ask)
        if len(keys) > 1:
            yield done()

    return run


SIGNED = "key bigint, n bigint, least array<bigint>, bits binary"
_SIGNED = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("least", pa.list_(pa.int64())), ("bits", pa.binary())])


def _signed_rows(batches):
    """Rows (key, set) -> key, n, the least hash under two scramblings, the bitmap."""
    for whole in batches:
        for first in range(0, whole.num_rows, 500):
            batch, out = whole.slice(first, 500), []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, dtype=np.uint64)
                least = [int(mix(x ^ salt).min().view(np.int64)) for salt in SALTS]
                out.append({"key": key, "n": len(x), "least": least, "bits": bitmap(x, bit_width(len(x))).tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=_SIGNED)


def _family_links(classes: DataFrame, signed: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links inside groups of one least hash. A group of more than `block` sets, or of more shingles than 2000 a set of
    that, is dealt into blocks, each with about eight of its sets as pivots."""
    named = signed.select("key", "n", F.posexplode("least").alias("nth", "hash")).select("key", "n", F.xxhash64("nth", "hash").alias("group"))
    groups = named.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    groups = groups.select("group", "members", F.ceil(F.greatest(F.col("members") / block, F.col("shingles") / (2000.0 * block))).alias("blocks"))
    members = written(named.join(written(groups, "ngram-groups"), "group").select("key", "group", "members", "blocks"), "ngram-members")
    rows = classes.select("key", "set").join(beside(members, 300_000), "key").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    is_pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("key", F.lit(7)), F.greatest(F.lit(1), F.expr("members div 8"))) == 0)
    to = F.when(is_pivot, F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array("block"))
    rows = rows.select("group", "key", "set", F.explode(to).alias("block"))
    tiles = rows.select(F.xxhash64("group", "block").alias("tile"), "key", F.lit(True).alias("asked"), "set").repartition("tile")
    return tiles.sortWithinPartitions("tile").mapInArrow(tidy(_compare(num, den)), "u bigint, v bigint")


# ---------------------------------------------------------------- 4. tiles


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands: a set's partners lie in its band or a neighbouring one."""
    limits = [1]
    while limits[-1] < most:
        limits.append(limits[-1] * den // num + 1)
    return np.array(limits)


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """How many of its n ordered shingles a set shows as the larger and as the smaller one of a pair."""
    return n + 1 - -(-num * n // den), n + 1 - -(-2 * num * n // (num + den))


def _print_rows(batches, buckets: int):
    """Rows (key, set) -> all shingles by bucket."""
    base = TaskContext.get().partitionId() << 24
    keys, sets, size, nth = [], [], 0, 0

    def done():
        sizes = np.array([len(x) for x in sets])
        return _bucketed(base + nth, keys, sizes, mix(np.concatenate(sets)), np.repeat(np.arange(len(sets)), sizes), buckets, keep=True)

    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys.append(key)
            sets.append(np.frombuffer(data, dtype=np.uint64))
            size += len(sets[-1])
            if size >= 500_000 or len(keys) >= 60_000:
                yield done()
                keys, sets, size, nth = [], [], 0, nth + 1
    if keys:
        yield done()


COUNTED = "batch bigint, owners binary, counts binary, bucket int, prints binary, holders binary, sets binary"
_COUNTED = pa.schema(
    [("batch", pa.int64()), ("owners", pa.binary()), ("counts", pa.binary()), ("bucket", pa.int32())]
    + [("prints", pa.binary()), ("holders", pa.binary()), ("sets", pa.binary())]
)


def _counted(batches):
    """Per batch and bucket: how many prints of an owner no other set has (owners, counts), and all other prints with
    their holder (SEVERAL: the batch knows who) and the number of sets that have them (at most 65535 is written)."""
    for rows in _groups(batches, "bucket"):
        out = []
        for batch_id, prints, owners, sums in _sums(rows):
            n, more = np.bincount(owners[sums == 1]), sums > 1
            some = np.flatnonzero(n)
            row = {"batch": batch_id, "owners": some.astype("<u2").tobytes(), "counts": n[some].astype("<u4").tobytes(), "bucket": rows[0]["bucket"]}
            out.append(row | {"prints": prints[more].tobytes(), "holders": owners[more].tobytes(), "sets": np.minimum(sums[more], 65_535).astype("<u2").tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=_COUNTED)


SHOWN = "key bigint, n bigint, band int, alone bigint, shown array<bigint>"
_SHOWN = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("band", pa.int32()), ("alone", pa.int64()), ("shown", pa.list_(pa.int64()))])


def _shown_rows(batches, num: int, den: int):
    """A batch's counts of all buckets -> key, n, band, number of shingles that only this set has, and of the others the
    first ones by (number of sets, shingle) up to the prefix length. Sets that show none cannot link and are left out."""
    for rows in _groups(batches, "batch"):
        named = next(r for r in rows if r["ids"] is not None)
        keys, sizes = named["ids"], named["sizes"]
        alone, found = np.zeros(len(keys), dtype=np.int64), [[np.zeros(0, np.int64)] for _ in range(3)]
        for r in rows:
            if r["ids"] is None:
                alone[np.frombuffer(r["owners"], "<u2")] += np.frombuffer(r["counts"], "<u4")
                prints = np.frombuffer(r["prints"], "<u4").astype(np.int64)
                for column, x in zip(found, (prints + (r["bucket"] << 32), np.frombuffer(r["holders"], "<u2"), np.frombuffer(r["sets"], "<u2")), strict=True):
                    column.append(x)
        tokens, holders, sets = map(np.concatenate, found)
        several = holders == SEVERAL  # each of them stands once; put its holders in its place
        order = np.argsort(tokens[several])
        common, common_sets = tokens[several][order], sets[several][order]
        mine = np.frombuffer(named["prints"], "<i8")
        tokens, holders = np.concatenate([tokens[~several], mine]), np.concatenate([holders[~several], np.frombuffer(named["owners"], "<u2")])
        sets = np.concatenate([sets[~several], common_sets[np.searchsorted(common, mine)]])
        order = np.lexsort((tokens, sets, holders))
        tokens, cuts = tokens[order], np.searchsorted(holders[order], np.arange(len(keys) + 1)).tolist()
        band = (np.searchsorted(bands(num, den), sizes, side="right") - 1).tolist()
        out = []
        for i, (key, n, a) in enumerate(zip(keys, sizes, alone.tolist(), strict=True)):
            most = prefix_lengths(n, num, den)[0] - a
            if most > 0 and cuts[i + 1] > cuts[i]:
                out.append({"key": key, "n": n, "band": band[i], "alone": a, "shown": tokens[cuts[i] : min(cuts[i + 1], cuts[i] + most)].tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=_SHOWN)


def _shown(classes: DataFrame, num: int, den: int) -> DataFrame:
    buckets = _n_buckets(classes.sparkSession, classes.agg(F.sum("n")).first()[0], 500_000)
    rows = written(classes.select("key", "set").mapInArrow(tidy(lambda b: _print_rows(b, buckets)), SIEVE), "ngram-prints")
    prints = rows.where("bucket >= 0").select("batch", "bucket", "prints", "owners", "times").repartition(buckets, "bucket")
    counted = prints.sortWithinPartitions("bucket").mapInArrow(tidy(_counted), COUNTED)
    parts = rows.where("bucket < 0").select("batch", "ids", "sizes", "prints", "owners").unionByName(counted, allowMissingColumns=True)
    return written(parts.repartition("batch").sortWithinPartitions("batch").mapInArrow(tidy(lambda b: _shown_rows(b, num, den)), SHOWN), "ngram-shown")


def _tile_pairs(batches, num: int, den: int):
    """Rows (tile, n, key, component, small, own, rest, side, *before), sorted by tile, n, key -> pairs of sets that may link.

    The smaller set of a pair must show the shingle as such, the larger one must be of the tile's own band. `side` tells
    the two chunks of a tile apart that is cut (0 and 1; -1 where all sets meet). Where a shingle is the first that both
    have, they share at most the `rest` of either set from there on. `before` are the shingles that a set
    shows before this one (-1: none): two sets that have one of them in common meet in its tile too, so that a pair comes
    out at the first shingle that both show, and seldom again."""
    left = None

    def pairs(rows: list[np.ndarray]):
        tile, n, key, component, small, own, rest, side, *before = rows
        at, found, step = np.flatnonzero(small), [], 1
        limit = n * den // num
        while len(at):
            at = at[at + step < len(tile)]
            to = at + step
            inside = (tile[to] == tile[at]) & (n[to] <= limit[at])
            at, to = at[inside], to[inside]
            good = own[to] & (component[at] != component[to]) & ((side[at] < 0) | (side[at] != side[to]))
            a, b = at[good], to[good]
            enough = (num + den) * np.minimum(rest[a], rest[b]) >= num * (n[a] + n[b])
            a, b = a[enough], b[enough]
            for x, y in itertools.product(before, before):
                fresh = (x[a] != y[b]) | (x[a] < 0)
                a, b = a[fresh], b[fresh]
            found.append(np.stack([np.minimum(key[a], key[b]), np.maximum(key[a], key[b])], axis=1))
            step += 1
        both = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        rows = rows if left is None else [np.concatenate(x) for x in zip(left, rows, strict=True)]
        last = int(np.searchsorted(rows[0], rows[0][-1], side="left")) if batch.num_rows else len(rows[0])
        left = [x[last:] for x in rows]
        if last:
            yield pairs([x[:last] for x in rows])
    if left is not None and len(left[0]):
        yield pairs(left)


def _candidates(shown: DataFrame, parts: DataFrame, num: int, den: int, chunk: int) -> DataFrame:
    """(u, v): pairs of sets of different components that share a tile and whose sizes allow a link."""
    rows = shown.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    rows = rows.select("key", "n", "band", "alone", "component", "shown", F.posexplode("shown").alias("pos", "shingle"))
    before = [f"before_{k}" for k in range(1, LOOK_BACK + 1)]
    rows = rows.withColumns({c: F.coalesce(F.get("shown", F.col("pos") - k), F.lit(-1)) for k, c in enumerate(before, 1)})
    as_small = F.expr(f"n + 1 - ((2 * {num} * n + {num + den - 1}) div {num + den})")
    rows = rows.withColumn("small", F.col("alone") + F.col("pos") < as_small).withColumn("rest", F.col("n") - F.col("alone") - F.col("pos"))
    bands_of = F.when(F.col("small"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.select("key", "n", "component", "small", "rest", "shingle", "band", *before, F.explode(bands_of).alias("up"))
    rows = rows.withColumn("band", F.col("band") + F.col("up")).withColumn("own", F.col("up") == 0).drop("up")
    rows = written(rows, "ngram-entries")
    tiles = rows.groupBy("shingle", "band").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"), F.max("own").alias("some"))
    tiles = written(tiles.where("low < high and some").select("shingle", "band", F.expr(f"cast(ceil(members / {chunk}) as int)").alias("chunks")), "ngram-tiles")
    rows = rows.join(tiles, ["shingle", "band"]).withColumn("mine", F.pmod(F.xxhash64("key", F.lit(5)), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tile = F.xxhash64("shingle", "band", F.least("mine", "other"), F.greatest("mine", "other")).alias("tile")
    side = F.when(F.col("mine") == F.col("other"), -1).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side")
    rows = rows.select(tile, "n", "key", "component", "small", "own", "rest", side, *before).repartition("tile").sortWithinPartitions("tile", "n", "key")
    return rows.mapInArrow(tidy(lambda b: _tile_pairs(b, num, den)), "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- 5. bound and intersection


def _bounded(batches, num: int, den: int):
    """Rows (u, v, n of u, n of v, bits of u, bits of v) -> u, v, and the most shingles they can share, where enough."""
    for whole in batches:
        for first in range(0, whole.num_rows, 5000):
            batch = whole.slice(first, 5000)
            u, v, nu, nv = (batch.column(i).to_numpy() for i in range(4))
            bits = [batch.column(i) for i in (4, 5)]
            widths = [pa.compute.binary_length(x).to_numpy() for x in bits]
            width, differ = np.minimum(*widths), np.zeros(len(u), dtype=np.int64)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                for part in np.array_split(at, max(1, len(at) * w // 8_000_000)):
                    laid = []
                    for column, wide in zip(bits, widths, strict=True):
                        both = np.zeros((len(part), w), dtype=np.uint8)
                        for full in np.unique(wide[part]).tolist():
                            of = np.flatnonzero(wide[part] == full)
                            data = b"".join(column.take(pa.array(part[of])).to_pylist())
                            both[of] = np.bitwise_or.reduce(np.frombuffer(data, dtype=np.uint8).reshape(len(of), full // w, w), axis=1)
                        laid.append(both.view(np.uint64))
                    differ[part] = np.bitwise_count(laid[0] ^ laid[1]).sum(axis=1, dtype=np.int64)
            most = (nu + nv - differ) // 2
            good = den * most >= num * (nu + nv - most)
            yield pa.RecordBatch.from_arrays([pa.array(x[good]) for x in (u, v, most)], names=["u", "v", "most"])


def _intersected(batches, num: int, den: int):
    """Rows (u, v, set of u, set of v) -> the linked ones."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in (2, 3))
            if linked(a, b, num, den):
                out.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def _links(classes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links of (key, set, n), enough to connect what is connected."""
    shown = _shown(classes, num, den)
    classes = classes.join(beside(shown.select("key")), "key", "left_semi")
    signed = written(classes.select("key", "set").mapInArrow(tidy(_signed_rows), SIGNED), "ngram-signed")
    found = written(_family_links(classes, signed, num, den, block), "ngram-links")

    def parts() -> DataFrame:
        return connected_components(found).withColumnRenamed("node", "key")

    def with_both(pairs: DataFrame, of: DataFrame) -> DataFrame:
        for end in "uv":
            pairs = pairs.join(of.select(*[F.col(c).alias(end if c == "key" else f"{c}_{end}") for c in of.columns]), end)
        return pairs

    def exact(pairs: DataFrame) -> DataFrame:
        rows = with_both(pairs.select("u", "v"), classes.select("key", "set")).select("u", "v", "set_u", "set_v")
        return rows.mapInArrow(tidy(lambda b: _intersected(b, num, den)), "u bigint, v bigint")

    def apart(pairs: DataFrame) -> DataFrame:
        known = written(parts(), "ngram-parts")
        for end in "uv":
            pairs = pairs.join(beside(known.select(F.col("key").alias(end), F.col("component").alias("part_" + end))), end, "left")
            pairs = pairs.withColumn("part_" + end, F.coalesce("part_" + end, end))
        return pairs.where("part_u <> part_v")

    pairs = with_both(_candidates(shown, parts(), num, den, 2 * block), signed.select("key", "n", "bits"))
    pairs = pairs.select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(tidy(lambda b: _bounded(b, num, den)), "u bigint, v bigint, most bigint")
    left = written(apart(written(pairs, "ngram-bounded")), "ngram-left")
    best = left.groupBy(F.least("part_u", "part_v").alias("a"), F.greatest("part_u", "part_v").alias("b"))
    best = best.agg(F.max(F.struct("most", "u", "v")).alias("best")).select("best.u", "best.v")
    found = written(found.unionByName(exact(best)), "ngram-links")
    rest = written(apart(left.select("u", "v")).select("u", "v"), "ngram-rest")
    return written(found.unionByName(exact(rest)), "ngram-links")


def ngram_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100, block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    A document's set is its distinct `words`-word shingles; two documents link when den * |intersection| >= num *
    |union|; component_id is the smallest id that links reach. Null and empty texts have no shingles and link with
    nothing; their component is their own id. Rows that repeat an id stand for one document as far as links go and each
    get a row; a null id is only its own component. block is how many sets one task compares at once; nothing is left
    out beyond it. Shingles and sets are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), body(text).alias("text"))
    sizes, may = _sieve(rows, words, num, den)
    texts = rows.join(beside(written(may, "ngram-may")), "id", "left_semi")
    sets = written(texts.mapInArrow(tidy(lambda b: _set_rows(b, words)), "id bigint, key bigint, n bigint, set binary"), "ngram-sets")
    classes = written(sets.groupBy("key").agg(F.max("set").alias("set"), F.min("id").alias("least"), F.max("n").alias("n")), "ngram-classes")
    links = _links(classes.select("key", "set", "n"), num, den, block)
    parts = connected_components(links).withColumnRenamed("node", "key")
    named = classes.select("key", "least").join(written(parts, "ngram-parts"), "key", "left")
    named = written(named.select("key", "least", F.coalesce("component", "key").alias("part")), "ngram-named")
    least = written(named.groupBy("part").agg(F.min("least").alias("component_id")), "ngram-least")
    by_key = written(named.join(least, "part").select("key", "component_id"), "ngram-by-key")
    by_id = sets.where("id is not null").select("id", "key").join(by_key, "key").groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = sizes.join(written(by_id, "ngram-by-id"), "id", "left")
    return out.select(F.col("id").alias(doc_id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def kept_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The filtering form: of every component the document with the smallest id stays, with the columns of docs, whatever
    their names. Rows that repeat that id all stay, and so do rows with a null id."""
    found = ngram_components(docs, doc_id=doc_id, text=text, **options).where(F.col("component_id") == F.col(doc_id))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.struct("*").alias("row"))
    kept = rows.join(found.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi")
    return kept.unionByName(rows.where("id is null")).select("row.*")
