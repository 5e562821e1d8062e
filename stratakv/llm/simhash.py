"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that differ in at most `radius` bits are found without comparing all pairs: the 64 bits are
split into `blocks` runs, and two such fingerprints agree on at least blocks - radius of them, so each
fingerprint goes to one bucket for each choice of that many runs (no link is lost). Inside a bucket the
fingerprints are turned into bit planes, 64 fingerprints a word; distances to a whole word are updated at
once with carry-save counters, and a word is abandoned as soon as all its 64 distances exceed the radius.

Equal fingerprints are folded before anything is compared, so copies cost nothing. Buckets over HOT rows are
dealt into chunks, and each pair of chunks is a task of its own. A bucket sends on a spanning forest only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakv.llm.common import by_batch, cut, dropped, lean, texts
from stratakv.llm.components import components, joined

#: Rows of a bucket that one task compares.
HOT = 1024
#: Mean rows of a bucket over which a finer key is used.
ROOMY = 256


# ---------------------------------------------------------------- fingerprints


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words joined by a space; the whole sequence if there are fewer; none for no words."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    digest, total, step = xxhash.xxh64_intdigest, 0, 1 << 15
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, max(1, len(words) - size + 1), step):
        some = shingles(words[at : at + step + size - 1], size)
        hashes = np.array([digest(x, seed) for x in some], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        total += len(some)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long): one row for each row of docs; null and blank texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(x, size) for x in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_batch(run), "doc_id long, fp long")


# ---------------------------------------------------------------- bit-sliced comparison


def near_pairs(values: np.ndarray, starts: np.ndarray, radius: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j inside the same group whose values differ in at most `radius` bits.

    values: uint64, group by group; starts: where each group begins. skip: bits known to agree in a group.
    """
    n = len(values)
    sizes = np.diff(np.append(starts, n))
    words_of = -(-sizes // 64)
    first_word = np.concatenate(([0], np.cumsum(words_of)))[:-1]
    group = np.repeat(np.arange(len(starts)), sizes)
    rank = np.arange(n) - starts[group]
    lane = first_word[group] * 64 + rank
    total_words = int(words_of.sum())
    of_lane = np.full(total_words * 64, -1, dtype=np.int64)
    of_lane[lane] = np.arange(n)
    planes = [b for b in range(64) if not skip >> b & 1]
    sliced = np.zeros((len(planes), total_words), dtype=np.uint64)
    spread = np.zeros(total_words * 64, dtype=np.uint8)
    for k, b in enumerate(planes):
        spread[lane] = (values >> np.uint64(b)) & np.uint64(1)
        sliced[k] = np.packbits(spread, bitorder="little").view(np.uint64)
    real = np.packbits(of_lane >= 0, bitorder="little").view(np.uint64)
    own = rank // 64  # words before it hold smaller ranks only
    reach = words_of[group] - own
    found_i, found_j = [], []
    ends = np.cumsum(reach)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16), side="right")))
        many = reach[at:upto]
        query = np.repeat(np.arange(at, upto), many)
        word = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + first_word[group[query]] + own[query]
        alive = within(values, sliced, planes, query, word, radius)
        query, word, hits = alive
        hits &= real[word]
        keep = hits != 0
        query, word, hits = query[keep], word[keep], hits[keep]
        if len(hits):
            row, bit = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            i, j = query[row], of_lane[word[row] * 64 + bit]
            found_i.append(i[j > i])
            found_j.append(j[j > i])
        at = upto
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


def within(values: np.ndarray, sliced: np.ndarray, planes: list[int], query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (query, word) blocks not abandoned, each with a bit for every one of its 64 values within the radius."""
    width = max(1, int(radius).bit_length())
    counter = [np.zeros(len(query), dtype=np.uint64) for _ in range(width)]
    over = np.zeros(len(query), dtype=np.uint64)
    mine = values[query]
    k = 0
    while k < len(planes) and len(query):
        some = [sliced[k + d][word] ^ (np.uint64(0) - ((mine >> np.uint64(planes[k + d])) & np.uint64(1))) for d in range(min(3, len(planes) - k))]
        if len(some) == 3:  # carry-save: three planes become a sum of weight 1 and a carry of weight 2
            x, y, z = some
            half = x ^ y
            adds = [(0, half ^ z), (1, (x & y) | (z & half))]
        else:
            adds = [(0, x) for x in some]
        for weight, carry in adds:
            for c in range(weight, width):
                counter[c], carry = counter[c] ^ carry, counter[c] & carry
            over |= carry
        k += len(some)
        if k % 8 < 3 and k > 3 * radius or k >= len(planes):
            live = ~(over | above(counter, radius))
            keep = np.flatnonzero(live)
            if len(keep) < len(query):
                query, word, mine, over = query[keep], word[keep], mine[keep], over[keep]
                counter = [c[keep] for c in counter]
    return query, word, ~(over | above(counter, radius))


def above(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits where the sliced counter is greater than radius."""
    more = np.zeros_like(counter[0])
    same = ~more
    for c in range(len(counter) - 1, -1, -1):
        if radius >> c & 1:
            same &= counter[c]
        else:
            more |= same & counter[c]
            same &= ~counter[c]
    return more


# ---------------------------------------------------------------- distributed


def runs(blocks: int) -> list[int]:
    """Masks of `blocks` adjoining runs of bits that make up 64."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def masks(radius: int, rows: int) -> list[int]:
    """Bits that make the key of each bucket table; finer ones for more rows. Any choice is exact."""
    for extra in (1, 2, 3):
        some = [sum(x) for x in combinations(runs(radius + extra), extra)]
        if rows >> min(x.bit_count() for x in some) <= ROOMY:
            break
    return some


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, keys: list[str], salt: str, hot: int = HOT) -> DataFrame:
    """rows with (part_a, part_b): a bucket of over `hot` rows is cut into chunks and each row goes to every pair with its chunk; chunk is the row's own."""
    large = rows.groupBy(*keys).count().where(F.col("count") > hot).select(*keys, F.ceil(F.col("count") / hot).cast("int").alias("chunks"))
    rows = rows.join(large, keys, "left").withColumn("chunk", F.when(F.col("chunks").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt, F.lit(7)), F.col("chunks"))).cast("int"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("other", other).withColumn("part_a", F.least("chunk", "other")).withColumn("part_b", F.greatest("chunk", "other")).drop("chunks", "other")


def links(reps: DataFrame, radius: int = 4, rows: int | None = None) -> DataFrame:
    """(u, v): a spanning forest of the pairs of distinct fingerprints that differ in at most `radius` bits, bucket by bucket."""
    kinds = masks(radius, reps.count() if rows is None else rows)
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(kinds)])
    keyed = reps.select("fp", F.explode(tables).alias("b")).select(F.col("b.t").alias("t"), F.col("b.key").alias("key"), "fp")
    ready = dealt(keyed, ["t", "key"], "fp").select("t", "key", "part_a", "part_b", "chunk", "fp")
    ready = ready.repartition("t", "key", "part_a", "part_b").sortWithinPartitions("t", "key", "part_a", "part_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, 4):
            t, key, a, b, chunk, fp = some
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in compare(fp, t, np.flatnonzero(changes([t, key, a, b])), np.where(a == b, -1, chunk), radius, kinds)], names=["u", "v"])

    return ready.mapInArrow(lean(run), "u long, v long").distinct()


def changes(columns: list[np.ndarray]) -> np.ndarray:
    first = np.ones(len(columns[0]), dtype=bool)
    first[1:] = False
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return first


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 16) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches as arrays, regrouped so that no run of equal keys (the first columns) is cut."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        count += batch.num_rows
        if count < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        last = int(np.flatnonzero(changes(columns[:keys]))[-1])
        if last:
            yield [c[:last] for c in columns]
        held, count = [[c[last:] for c in columns]], len(columns[0]) - last
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def compare(fp: np.ndarray, t: np.ndarray, starts: np.ndarray, side: np.ndarray, radius: int, kinds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges from fingerprints to the smallest index of their part; side: -1 compares with all, else only other sides do."""
    sizes = np.diff(np.append(starts, len(fp)))
    many = np.repeat(sizes > 1, sizes)
    out_u, out_v = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for kind in np.unique(t[many]):
        pick = np.flatnonzero(many & (t == kind))
        group = np.repeat(np.arange(len(starts)), sizes)[pick]
        values = fp[pick].view(np.uint64)
        i, j = near_pairs(values, np.flatnonzero(changes([group])), radius, kinds[kind])
        apart = (side[pick][i] != side[pick][j]) | (side[pick][i] < 0)
        root = joined(len(values), i[apart], j[apart])
        moved = np.flatnonzero(root != np.arange(len(root)))
        out_u.append(fp[pick][moved])
        out_v.append(fp[pick][root[moved]])
    return np.concatenate(out_u), np.concatenate(out_v)


def near_dups(docs: DataFrame, size: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of docs.

    Null and blank texts have fingerprint 0 and are linked like any other. component_id is the smallest
    non-null doc_id of all rows reachable (null if all those are null). Repeated rows come out repeated; other
    columns of docs are ignored, so their names cannot clash. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, size, id_col, text_col))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(reps.select("fp"), radius))
    placed = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by similarity

#: Minima of a set, and how many of them make the key of a block. Both only propose pairs.
MINIMA, BAND = 32, 4
#: Rows of a block that are compared at once; a larger block is a star of such parts.
PART = 512
#: Bits in which the fingerprints of proposed pairs differ at most.
WIDE = 18
#: Parity bits of a set of up to so many elements. Longer rows fold to shorter ones.
PARITY = ((1024, 512), (8192, 2048), (1 << 62, 8192))
#: Texts, about, that common shingles are counted in; how many texts make a shingle common; how many such are told apart.
SAMPLE, COMMON, MOST = 20_000, 5, 1 << 16
#: Added to what is compared with a product of similarities, so that rounding drops no pair.
EPS = 1e-6
#: Odd factors, by which a set's hashes are put in another order for each of its minima.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 2 * MINIMA, 2)], dtype=np.uint64)


def shingle_set(text: bytes, size: int = 5) -> np.ndarray:
    """XXH64 of the distinct shingles of a whole text, in order; none for a text without words."""
    words = text.lower().split()
    digest, step = xxhash.xxh64_intdigest, 1 << 15
    found = [np.empty(0, dtype=np.uint64)]
    for at in range(0, max(1, len(words) - size + 1), step):
        found.append(np.unique(np.array([digest(x, 42) for x in shingles(words[at : at + step + size - 1], size)], dtype=np.uint64)))
    return np.unique(np.concatenate(found))


def majority(hashes: np.ndarray) -> int:
    """Majority bits of the hashes; 0 for none."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first keys of a set in an order that all sets share: by hash, common shingles last (common: sorted hashes).

    Two sets that are `similarity` alike share at least ceil(similarity * n) shingles of each one's n, so they
    share one of their first n - ceil(similarity * n) + 1. Keys lose the lowest bit of a hash, which adds pairs at most.
    """
    keys = hashes >> np.uint64(1)
    if len(common):
        spot = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        keys = np.sort(keys | (common[spot] == hashes).astype(np.uint64) << np.uint64(63))
    return keys[: len(keys) - math.ceil(similarity * len(keys) - EPS) + 1]


def parity(hashes: np.ndarray) -> bytes:
    """Bits, each the parity of how many of the hashes fall to it: two sets differ in as many elements at least as these differ in bits."""
    width = next(bits for most, bits in PARITY if len(hashes) <= most)
    return np.packbits(np.bincount((hashes >> np.uint64(8)).astype(np.int64) & width - 1, minlength=width) & 1).tobytes()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of blocks: each the hash of BAND of the set's MINIMA minima, which two sets share as often as they are alike. None for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        np.minimum(least, (hashes[at : at + (1 << 13), None] * FACTORS).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(-1, BAND))], dtype=np.uint64).view(np.int64)


class Parities:
    """Parity bits of many sets, as rows of uint64 in each width."""

    def __init__(self, rows: list[bytes]) -> None:
        self.kind = np.array([next(k for k, (_, bits) in enumerate(PARITY) if 8 * len(x) == bits) for x in rows], dtype=np.int64)
        self.place, self.folded = [], []
        for k, (_, bits) in enumerate(PARITY):
            some = np.flatnonzero(self.kind >= k)
            place = np.zeros(len(rows), dtype=np.int64)
            place[some] = np.arange(len(some))
            self.place.append(place)
            self.folded.append(np.array([np.bitwise_xor.reduce(np.frombuffer(rows[r], dtype=np.uint64).reshape(-1, bits // 64), axis=0) for r in some], dtype=np.uint64).reshape(len(some), bits // 64))

    def differing(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bits that differ, bits compared) of pairs."""
        kind = np.minimum(self.kind[i], self.kind[j])
        out = np.zeros(len(i), dtype=np.int64)
        for k, (_, bits) in enumerate(PARITY):
            pick = np.flatnonzero(kind == k)
            rows, place, step = self.folded[k], self.place[k], max(1, (1 << 22) // bits)
            for at in range(0, len(pick), step):
                some = pick[at : at + step]
                out[some] = np.bitwise_count(rows[place[i[some]]] ^ rows[place[j[some]]]).sum(axis=1)
        return out, np.array([bits for _, bits in PARITY])[kind]


def common_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of shingles that stand in COMMON or more of a sample of texts. Which ones they are moves work only, never a result."""
    part = F.lit(min(1 << 20, int(SAMPLE * (1 << 20) / max(docs.count(), 1)) + 1))
    some = docs.select(F.xxhash64("text", F.lit(1)).alias("of"), "text").where(F.pmod("of", F.lit(1 << 20)) < part).dropDuplicates(["of"]).select("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, size).view(np.int64) for x in texts(batch.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sets]))], names=["h"])

    top = some.mapInArrow(by_batch(run), "h long").groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST)
    return np.sort(np.array([r.h for r in top.collect()], dtype=np.int64).view(np.uint64))


def estimated(n_i: np.ndarray, n_j: np.ndarray, differing: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarity of sets of n_i and n_j elements whose parity bits differ so often."""
    apart = -bits / 2 * np.log(1 - 2 * np.minimum(differing, bits * 0.49) / bits)
    apart = np.maximum(apart, np.abs(n_i - n_j))
    return (n_i + n_j - apart) / np.maximum(n_i + n_j + apart, 1)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs that make a spanning forest of n items, earlier pairs first."""
    root, left, chosen = np.arange(n), np.arange(len(i)), [np.empty(0, dtype=np.int64)]
    while len(left):
        a, b = root[i[left]], root[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        best = np.full(n, len(i))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        pick = np.unique(best[best < len(i)])
        chosen.append(pick)
        root = joined(n, np.concatenate([np.arange(n), i[pick]]), np.concatenate([root, j[pick]]))
    return np.concatenate(chosen)


def proposed(fp: np.ndarray, n: np.ndarray, bits: list[bytes], starts: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that the fingerprints, bit-sliced, and then the parity bits find alike: a spanning forest of the likeliest."""
    i, j = near_pairs(fp.view(np.uint64), starts, radius)
    n = n.astype(np.float64)
    alike = estimated(n[i], n[j], *Parities(bits).differing(i, j))
    order = np.argsort(-alike, kind="stable")
    order = order[alike[order] >= similarity]
    i, j = i[order], j[order]
    pick = spanning(len(fp), i, j)
    return i[pick], j[pick]


def crossing(group: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: Parities, similarity: float, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a group and of two components that can be `similarity` alike, by their sizes n, their parity bits, and if their first common key is at position `at` of each. Rows lie by group, then n."""
    place = group << 32
    upto = np.searchsorted(place + n, place + np.minimum(n / similarity + EPS, 2.0**31).astype(np.int64), side="right")
    many = upto - np.arange(len(n)) - 1
    ends = np.cumsum(many)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        count = many[first:last]
        i = np.repeat(np.arange(first, last), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + i + 1
        keep = (comp[i] != comp[j]) & ((side[i] != side[j]) | (side[i] < 0))
        i, j = i[keep], j[keep]
        keep = np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - EPS
        i, j = i[keep], j[keep]
        keep = bits.differing(i, j)[0] <= (1 - similarity) / (1 + similarity) * (n[i] + n[j]) + EPS
        yield i[keep], j[keep]
        first = last


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose whole sets of shingles are `similarity` alike."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    spot = F.pmod(F.xxhash64("doc_id", "of"), F.lit(1 << 25))
    # a Bloom filter of one hash and 4 MB at most, so that only texts of pairs are moved
    chosen = cut(reps.join(wanted, "node").select("doc_id", F.col("node").alias("of")))
    words = chosen.groupBy(F.shiftright(spot, 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id, of), 64) as int))")).alias("bits")).toArrow()
    bloom = np.zeros(1 << 19, dtype=np.uint64)
    bloom[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.column(1).to_numpy()
        keep = pa.array((bloom[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
        batch = batch.filter(keep)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(x, size).tobytes() for x in texts(batch.column(2))], type=pa.binary())], names=["node", "set"])

    def same(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(shared / max(len(x) + len(y) - shared, 1) >= similarity)
        return batch.select(["u", "v"]).filter(pa.array(keep, type=pa.bool_()))

    at = docs.select("of", spot.alias("at"), "text")
    whole = cut(at.mapInArrow(by_batch(sets), "node long, set binary").dropDuplicates(["node"]))
    both = pairs.join(whole.toDF("u", "a"), "u").join(whole.toDF("v", "b"), "v").select("u", "v", "a", "b")
    out = cut(both.mapInArrow(by_batch(same), "u long, v long"))
    dropped(chosen, whole)
    return out


def alike(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """(doc_id, of, fp, root, component_id), all long: near_copies() with the text's xxhash64 and the component's own number (null for a null id without an equal text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of"), "text")
    common = common_shingles(docs, size)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_set(x, size) for x in texts(batch.column(2))]
        prints = pa.array(np.array([majority(s) for s in made], dtype=np.uint64).view(np.int64))
        whole = pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in made], dtype=np.uint64).view(np.int64))
        longs = pa.list_(pa.int64())
        bands, keys = pa.array([band_keys(s) for s in made], type=longs), pa.array([prefix(s, similarity, common).view(np.int64) for s in made], type=longs)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints, whole, pa.array([len(s) for s in made], type=pa.int32()), pa.array([parity(s) for s in made], type=pa.binary()), bands, keys], names=["doc_id", "of", "fp", "sk", "n", "bits", "bands", "keys"])

    prints = cut(docs.mapInArrow(by_batch(run), "doc_id long, of long, fp long, sk long, n int, bits binary, bands array<long>, keys array<long>"))
    kept = [F.first(c).alias(c) for c in ("n", "bits", "bands", "keys")]
    reps = prints.where("doc_id is not null").groupBy("fp", "sk").agg(F.min(F.struct("of", "doc_id")).alias("m"), F.min("doc_id").alias("least"), *kept)
    reps = cut(reps.select("fp", "sk", F.col("m.of").alias("node"), F.col("m.doc_id").alias("doc_id"), "least", "n", "bits", "bands", "keys"))
    keyed = reps.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    # a large block is cut into parts, and its first part is compared with each: what this leaves apart is found below
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int")
    part = F.explode(F.when(own == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))).alias("part")
    ready = keyed.join(shared, "key").select("key", "node", part).join(reps.select("node", "fp", "n", "bits"), "node").select("key", "part", "fp", "n", "node", "bits")
    ready = ready.repartition("key", "part").sortWithinPartitions("key", "part")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, fp, n, node, bits in whole_groups(batches, 2, 1 << 12):
            i, j = proposed(fp, n, list(bits), np.flatnonzero(changes([key, part])), radius, similarity)
            u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    pairs = cut(ready.mapInArrow(lean(block), "u long, v long").distinct())
    sure = confirmed(pairs, docs, reps, size, similarity)
    found = components(sure)

    placed = reps.join(found, "node", "left").select("node", "n", F.coalesce("root", "node").alias("comp"), "keys")
    mixed = placed.select("comp", F.explode("keys").alias("key")).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rows = cut(placed.select("node", "n", "comp", F.posexplode("keys").alias("at", "key")).join(mixed, "key"))
    open_ = dealt(rows, ["key"], "node").join(reps.select("node", "bits"), "node").select("key", "part_a", "part_b", "n", "at", "comp", "chunk", "node", "bits")
    open_ = open_.repartition("key", "part_a", "part_b").sortWithinPartitions("key", "part_a", "part_b", "n")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, a, b, n, at, comp, chunk, node, bits in whole_groups(batches, 3, 1 << 14):
            group = np.cumsum(changes([key, a, b]))
            for i, j in crossing(group, n.astype(np.int64), at, comp, np.where(a == b, -1, chunk), Parities(list(bits)), similarity):
                u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
                pairs = np.unique(np.stack([u, v], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["u", "v"])

    others = cut(open_.mapInArrow(lean(across), "u long, v long").distinct())
    rest = confirmed(others, docs, reps, size, similarity)
    roots = components(sure.union(rest))
    placed = cut(reps.select("fp", "sk", "node", "least").join(roots, "node", "left").select("fp", "sk", "least", F.coalesce("root", "node").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(smallest, "root").select("fp", "sk", "root", "component_id")
    dropped(reps, pairs, sure, found, rows, others, rest, roots)
    return prints.select("doc_id", "of", "fp", "sk").join(placed, ["fp", "sk"], "left").select("doc_id", "of", "fp", "root", "component_id")


def near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """(doc_id, fp long, component_id): documents linked where their sets of word shingles are `similarity` alike or more.

    No pair is lost: every link is decided on the whole sets, and every pair that shares a key of prefix() is decided, but for
    those already in one component and those that sizes, positions and parity bits rule out. To have few such pairs left, blocks of
    documents that share BAND minima are compared before, by fingerprints of the sets, bit-sliced, and
    parity bits; a block proposes a spanning forest only. Documents of equal sets are folded first, and large blocks are
    dealt out. Texts without words are all alike. component_id is the smallest doc_id of the
    component; that of a null id is that of an equal set, or null. Rows that share an id are rows of their own. Other columns are ignored.
    """
    return alike(docs, size, similarity, radius).select("doc_id", "fp", "component_id")
