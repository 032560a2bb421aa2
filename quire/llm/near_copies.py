"""Records that share most of their words' n-grams, found exactly without comparing all pairs.

Each record is the set of hashes of its runs of consecutive words, put in one global order, rare
ones first. The order comes from a count sketch of fixed size over all records; any order gives the
same pairs, a good one gives fewer candidates. The ordered sets form a prefix tree of which only the
branches that a similar record must share are stored: two sets of the wanted similarity share an
n-gram within short prefixes. A branch, an n-gram with the records that have it in their prefix, is
visited once for all of its records; pairs are pruned by length, by what remains of both sets behind
the place they share, and by a lower bound of their difference from 512-bit parity signatures. All
three bounds are exact. What is left is verified on the whole sets.

Equal sets are one class from the start and are never compared with each other.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Counters of the sketch: 16 MB, however many records there are.
SKETCH_BITS = 22
#: Records per shard of branches beyond the least number of shards.
PER_SHARD, LEAST_SHARDS = 50_000, 12
#: An n-gram of more records is met in parts: each two parts are one branch, and a record is in one for each part.
HOT = 20_000
#: Pairs looked at in one step of numpy.
STEP = 1 << 20
#: A class of more equal sets is linked to its first record, not expanded into all pairs.
EXPANDED = 200

_WORD = re.compile(r"[^\W_]+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Hashes(dict):
    """Hashes of words, made when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    """Sets of n-gram hashes of word lists; hashes of words are remembered."""

    def __init__(self, size: int):
        self.size = size
        self.known = _Hashes()

    def sets(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text's runs of ``size`` words."""
        known = self.known
        h = np.array([known[w] for t in texts for w in t], dtype=np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        n = max(0, len(h) - self.size + 1)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(self.size):
            mixed = (mixed ^ (h[k : k + n] * _A)) * _B
            mixed ^= mixed >> np.uint64(29)
        mixed *= _C
        mixed ^= mixed >> np.uint64(32)
        begin, out = 0, []
        for end in ends:
            out.append(np.unique(mixed[begin : max(begin, end - self.size + 1)]))
            begin = end
        return out


def _class_of(s: np.ndarray) -> int:
    """One 64-bit number per set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _prepared(batch: pa.RecordBatch, shingler: Shingler, least_words: int):
    """Row numbers, sets and classes of the rows whose body has enough words."""
    key, head, body = (batch.column(i).to_pylist() for i in range(3))
    rows, texts = [], []
    for i in range(len(key)):
        b = body[i]
        if key[i] is None or not b:
            continue
        words = _WORD.findall(b.lower())
        if len(words) >= least_words:
            rows.append(i)
            texts.append(_WORD.findall(head[i].lower()) + words if head[i] else words)
    sets = shingler.sets(texts)
    keep = [k for k in range(len(sets)) if len(sets[k])]
    return [rows[k] for k in keep], [sets[k] for k in keep], [_class_of(sets[k]) for k in keep]


def _prefixes(n: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """How many of the first n-grams a set of n needs against shorter sets, and against longer ones."""
    e = 1e-9
    return n - np.ceil(t * n - e).astype(int) + 1, n - np.ceil(2 * t / (1 + t) * n - e).astype(int) + 1


def _branch_pairs(cls, n, bits, row, gram, place, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of records that no bound excludes, out of the branches of one shard.

    ``row``, ``gram`` and ``place`` are one entry per stored n-gram: whose, which, where in its order.
    """
    _, short = _prefixes(n, t)
    order = np.lexsort((cls[row], n[row], gram))
    row, gram, place = row[order], gram[order], place[order]
    size = n[row].astype(np.int64)
    new = np.concatenate([[True], gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, bool)
    branch = np.cumsum(new).astype(np.int64)
    key = (branch << 32) | size
    longest = np.floor(size / t + 1e-9).astype(np.int64)
    stop = np.searchsorted(key, (branch << 32) | longest, side="right")
    many = np.where(place < short[row], stop - np.arange(len(row)) - 1, 0)
    first = np.nonzero(many > 0)[0]
    many = many[first]
    upto = np.cumsum(many)
    got_a, got_b = [], []
    lo = 0
    while lo < len(first):
        base = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, base + STEP, side="right")))
        m = many[lo:hi]
        a = np.repeat(first[lo:hi], m)
        b = a + 1 + np.arange(len(a)) - np.repeat(upto[lo:hi] - m - base, m)
        lo = hi
        na, nb = size[a], size[b]
        need = np.ceil(t / (1 + t) * (na + nb) - 1e-9)
        ok = np.minimum(na - place[a], nb - place[b]) >= need
        a, b, room = row[a[ok]], row[b[ok]], (na + nb - 2 * need)[ok]
        differ = np.zeros(len(a), dtype=np.int64)
        for w in range(bits.shape[1]):
            differ += np.bitwise_count(bits[a, w] ^ bits[b, w])
            if w % 2:  # most pairs are out after a part of the signature
                ok = differ <= room
                a, b, room, differ = a[ok], b[ok], room[ok], differ[ok]
        ok = cls[a] != cls[b]
        if ok.any():
            got_a.append(a[ok])
            got_b.append(b[ok])
    if not got_a:
        return np.zeros(0, int), np.zeros(0, int)
    a, b = np.concatenate(got_a), np.concatenate(got_b)
    pair = np.unique(np.minimum(a, b) * len(cls) + np.maximum(a, b))
    return pair // len(cls), pair % len(cls)


def classes_and_links(
    df: DataFrame, key: str, head: str, body: str, similarity: float = 0.5, size: int = 3, least_words: int = 20
) -> tuple[DataFrame, DataFrame]:
    """(members, links): (key, cls) for every record that counts, and (cls_a, cls_b, jaccard) for
    every two classes whose sets have at least ``similarity`` of their union in common.

    A record's words are the runs of letters and digits of head, a blank and body in lower case; it
    counts if its body alone has ``least_words`` of them, whatever its length. Null keys and bodies
    don't count, a null head is empty. A key with several texts is in several classes. Exact up to
    collisions of 64-bit hashes. Empty tables give no rows.
    """
    t = similarity
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    source = df.select(key, head, body).where(F.col(key).isNotNull() & F.col(body).isNotNull())

    def count(batches):
        shingler, sketch, waiting = Shingler(size), np.zeros(1 << SKETCH_BITS, dtype=np.int64), []
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows, sets, classes = _prepared(part, shingler, least_words)
                if not rows:
                    continue
                waiting.append((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if len(waiting) >= 50:
                    sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
                    waiting.clear()
                none = pa.nulls(len(rows), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(classes, pa.int64()), none, none], ["key", "cls", "bucket", "m"]
                )
        if waiting:
            sketch += np.bincount(np.concatenate(waiting), minlength=len(sketch))
        at = np.nonzero(sketch)[0]
        for lo in range(0, len(at), 100_000):
            k = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(k), _arrow(kind)), pa.nulls(len(k), pa.int64()), pa.array(k, pa.int32()), pa.array(sketch[k], pa.int32())],
                ["key", "cls", "bucket", "m"],
            )

    first = cut(source.mapInArrow(count, f"key {kind}, cls bigint, bucket int, m int"))
    members = first.where("key is not null").select("key", "cls").distinct()
    counted = first.where("bucket is not null").groupBy("bucket").agg(F.sum("m").alias("m")).where("m > 1").toArrow()
    sketch = np.ones(1 << SKETCH_BITS, dtype=np.uint32)
    sketch[np.asarray(counted.column("bucket"))] = np.minimum(np.asarray(counted.column("m")), 2**32 - 1)
    shared = spark.sparkContext.broadcast(sketch)
    shards = max(LEAST_SHARDS, first.where("key is not null").count() // PER_SHARD)

    def branches(batches):
        shingler, common, seen = Shingler(size), shared.value, set()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                _, sets, classes = _prepared(b.slice(lo, 1000), shingler, least_words)
                fresh = []
                for k, c in enumerate(classes):
                    if c not in seen:
                        seen.add(c)  # equal sets of one task go out once
                        fresh.append(k)
                if not fresh:
                    continue
                sets, classes = [sets[k] for k in fresh], [classes[k] for k in fresh]
                n = np.array([len(s) for s in sets])
                doc, h = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
                m = common[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.lexsort((h, m, doc))
                h, m = h[order], m[order].astype(np.int64)
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                odd = np.bincount(doc * 512 + (h & np.uint64(511)).astype(np.int64), minlength=512 * len(sets)).reshape(-1, 512) & 1
                bits = [r.tobytes() for r in np.packbits(odd.astype(np.uint8), axis=1)]
                long_, _ = _prefixes(n, t)
                keep = (place < long_[doc]) & (m > 1)  # an n-gram counted once is nobody else's
                doc, h, place, m = doc[keep], h[keep], place[keep], m[keep]
                many = -(-m.astype(np.int64) // HOT)
                if (many > 1).any():
                    doc, h, place, most = (np.repeat(x, many) for x in (doc, h, place, many))
                    other = np.arange(len(most)) - np.repeat(np.cumsum(many) - many, many)
                    own = (np.array(classes, dtype=np.int64).view(np.uint64)[doc] % most.astype(np.uint64)).astype(np.int64)
                    two = (np.minimum(own, other) * 1_000_003 + np.maximum(own, other)).astype(np.uint64)
                    mixed = (h ^ (two * _A)) * _B
                    h = np.where(most > 1, mixed ^ (mixed >> np.uint64(29)), h)
                shard = ((h >> np.uint64(9)) % np.uint64(shards)).astype(np.int64)
                group = doc * shards + shard
                by = np.argsort(group, kind="stable")
                group = group[by]
                entry = np.empty(len(by), dtype=[("gram", "<u4"), ("place", "<u4")])
                entry["gram"], entry["place"] = (h[by] >> np.uint64(16)).astype(np.uint32), place[by]
                cuts = np.nonzero(np.diff(group, prepend=-1))[0]
                at, raw = np.append(cuts, len(group)), entry.tobytes()
                who = group[cuts] // shards
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(group[cuts] % shards, pa.int32()),
                        pa.array(np.array(classes, dtype=np.int64)[who]),
                        pa.array(n[who], pa.int32()),
                        pa.array([bits[i] for i in who], pa.binary()),
                        pa.array([raw[8 * a : 8 * z] for a, z in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    ["shard", "cls", "n", "bits", "grams"],
                )

    def visit(table: pa.Table) -> pa.Table:
        cls, n = np.asarray(table.column("cls")), np.asarray(table.column("n"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(-1, 8)
        grams = table.column("grams").to_pylist()
        row = np.repeat(np.arange(len(cls)), [len(g) // 8 for g in grams])
        entry = np.frombuffer(b"".join(grams), dtype=[("gram", "<u4"), ("place", "<u4")])
        a, b = _branch_pairs(cls, n, bits, row, entry["gram"], entry["place"].astype(np.int64), t)
        x, y = np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])
        return pa.table({"cls_a": pa.array(x, pa.int64()), "cls_b": pa.array(y, pa.int64())})

    candidates = cut(
        source.mapInArrow(branches, "shard int, cls bigint, n int, bits binary, grams binary")
        .groupBy("shard")
        .applyInArrow(visit, "cls_a bigint, cls_b bigint")
        .distinct()
    )

    def whole(batches):
        shingler = Shingler(size)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                _, sets, classes = _prepared(b.slice(lo, 1000), shingler, least_words)
                if sets:
                    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
                    flat = pa.array(np.concatenate(sets).view(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["cls", "grams"]
                    )

    wanted = candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    speakers = members.groupBy("cls").agg(F.min("key").alias(key)).join(wanted, "cls", "left_semi").select(key).distinct()
    sets = (
        source.join(speakers, key, "left_semi")
        .mapInArrow(whole, "cls bigint, grams array<bigint>")
        .dropDuplicates(["cls"])
    )
    same = F.size(F.array_intersect("x", "y"))
    links = (
        candidates.join(sets.select(F.col("cls").alias("cls_a"), F.col("grams").alias("x")), "cls_a")
        .join(sets.select(F.col("cls").alias("cls_b"), F.col("grams").alias("y")), "cls_b")
        .select("cls_a", "cls_b", (same / (F.size("x") + F.size("y") - same)).alias("jaccard"))
        .where(F.col("jaccard") >= t)
    )
    return members, links


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), the smaller key first: the links between classes written out for their
    records, and the pairs within a class.

    Of a class of more than ``EXPANDED`` records only its first record is written out in pairs with
    other classes, and its records are paired with the first alone; the members say the rest.
    """
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("first"))
    shown = members.join(sizes, "cls").where((F.col("m") <= EXPANDED) | (F.col("key") == F.col("first")))
    side = lambda x: shown.select(F.col("cls").alias(f"cls_{x}"), F.col("key").alias(x))
    across = links.select("cls_a", "cls_b").join(side("a"), "cls_a").join(side("b"), "cls_b").select("a", "b")
    plural = members.join(sizes.where("m > 1"), "cls")
    small = plural.where(F.col("m") <= EXPANDED).select("cls", "key")
    within = small.select("cls", F.col("key").alias("a")).join(small.select("cls", F.col("key").alias("b")), "cls").select("a", "b")
    star = plural.where(F.col("m") > EXPANDED).select(F.col("first").alias("a"), F.col("key").alias("b"))
    return (
        across.union(within.where("a < b"))
        .union(star)
        .where("a <> b")
        .select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
        .distinct()
    )
