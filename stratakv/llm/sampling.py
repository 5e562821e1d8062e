"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text factorises at words that no piece spans, so the forward sums are computed once for each
distinct word and kept by the worker. Sampling walks all words of a batch backwards in lockstep: each step draws one
arc for every word still open, by the cumulative weights of the arcs that end where it stands. Draws are a hash of
the row's key, the word's place and the step, so that a row is segmented alike on every run and machine.

Lockstep pays only side by side, so a word of over LONG_WORD characters is cut into the runs between which no piece of
it crosses, each then a word with a place of its own; a run that is still longer is filtered and sampled alone.

A piece of rank r weighs (r + 2) ** -sharpness, the rank being the model's order of merges. Characters without a
piece are spelt in byte pieces; so is the mark that stands for a space when the text itself has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratakv.llm.common import Batches, lean, slices
from stratakv.llm.mixing import hash_of, mixed
from stratakv.llm.pieces import BYTE, NORMAL, SPACE, model_bytes, processor, vocabulary, word_pattern

SHARPNESS = 1.0
#: Bytes of words and arcs that a worker keeps, about; beyond that it starts anew.
REMEMBERED = 64 << 20
#: What a word, an arc and a node with its character are taken to cost.
WORD_BYTES, ARC_BYTES, NODE_BYTES = 150, 9, 6
#: Items by which its arrays grow.
GROW = 1 << 19
#: Characters of new words that are filtered at once, words that are sampled at once, and bytes of texts taken at once.
AT_ONCE, WORDS_AT_ONCE, TEXTS_AT_ONCE = 32_000, 1 << 16, 1 << 19
#: Characters of a text that is cut into words at once; longer ones are cut word by word.
LONG = 1 << 19
#: Characters of a word that goes in lockstep with others. A longer one is cut where no piece crosses; what is still longer goes alone, for lockstep pays only side by side.
LONG_WORD = 256
#: Factors of the two hashes by which runs of characters are looked up; both have to agree.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: What is added to a word's draw at each step, and the range of a draw.
STRIDE, WORD64 = 0xD1B54A32D192ED03, (1 << 64) - 1


def code_hashes(text: str) -> np.ndarray:
    return mixed(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n items."""
    return x if n <= len(x) else np.concatenate([x, np.empty(n - len(x) + GROW, dtype=x.dtype)])


def run_hashes(some: list[str], n: int) -> list[np.ndarray]:
    """Both hashes of runs of n characters."""
    codes = code_hashes("".join(some)).reshape(-1, n)
    powers = [np.array([pow(f, n - 1 - k, 1 << 64) for k in range(n)], dtype=np.uint64) for f in FACTORS]
    return [(codes * w).sum(axis=1, dtype=np.uint64) for w in powers]


def spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, as many numbers for each."""
    return np.arange(int(many.sum())) + np.repeat(begin - np.cumsum(many) + many, many)


class Lattice:
    """Arcs of all words met so far. A node's arcs stand together from `first` on: their cumulative probability, length (0 if the word starts there) and piece."""

    def __init__(self, model: bytes, sharpness: float = SHARPNESS) -> None:
        sp, words = processor(model), vocabulary(model)
        self.pieces = {p.replace(SPACE, " "): (i, float((2.0 - sp.get_score(i)) ** -sharpness)) for i, (p, kind) in enumerate(words) if kind == NORMAL}
        self.byte = np.zeros(256, dtype=np.int64)
        for i, (p, kind) in enumerate(words):
            if kind == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.size = len(words)
        self.rare = float((2.0 + self.size) ** -sharpness)
        self.longest = max(map(len, self.pieces))
        self.pattern = word_pattern(model)
        self.tables = [self.table_of(n) for n in range(1, self.longest + 1)]
        self.clear()

    def table_of(self, n: int) -> tuple[np.ndarray, ...]:
        """(first hash ascending, where its top bits begin, second hash, id, weight, filter) of pieces of n characters."""
        some = [p for p in self.pieces if len(p) == n]
        first, second = run_hashes(some, n)
        order = np.argsort(first)
        found = [self.pieces[p] for p in some]
        begin = np.searchsorted(first[order], np.arange(1 << 16, dtype=np.uint64) << np.uint64(48))
        maybe = np.zeros(1 << 17, dtype=np.uint8)  # by the first hash's top bits: 1 for a piece, 2 for the end of a longer one; most runs of characters are neither
        maybe[first >> np.uint64(47)] = 1
        maybe[run_hashes(sorted({p[-n:] for p in self.pieces if len(p) > n}), n)[0] >> np.uint64(47)] |= 2
        return first[order], begin, second[order], np.array([i for i, _ in found], dtype=np.int32)[order], np.array([w for _, w in found])[order], maybe

    def clear(self) -> None:
        self.forget()
        self.reach, self.length, self.piece, self.first = (np.empty(1024, dtype=t) for t in (np.float32, np.uint8, np.int32, np.int32))

    def forget(self) -> None:
        """Starts anew in the same arrays."""
        self.ends: dict[str, int] = {}
        self.spelt: dict[str, int] = {}
        self.spellings: list[list[int]] = []
        self.alone: dict[int, int] = {}  # last node of words that go alone: characters
        self.nodes = self.arcs = self.held = 0

    def spell(self, char: str) -> int:
        """The id of a character without a piece: its byte piece, or a number from `size` on for several."""
        raw = char.encode()
        if len(raw) == 1:
            return int(self.byte[raw[0]])
        if char not in self.spelt:
            self.spelt[char] = self.size + len(self.spellings)
            self.spellings.append([int(self.byte[b]) for b in raw])
        return self.spelt[char]

    def add(self, words: list[str]) -> None:
        """Forward filtering of new words: a step handles the n-th characters of all of them."""
        words = sorted(words, key=len, reverse=True)
        size = np.array([len(w) for w in words])
        text, many = "".join(words), len(words)
        start = np.cumsum(size) - size
        rank = np.arange(len(text)) - np.repeat(start, size) + 1
        pos, length, ids, weight = self.arcs_of(text, rank)
        slot = np.arange(len(text)) + np.repeat(np.arange(many), size) + 1  # one more a word, for its start
        sums = np.zeros(len(text) + many)
        sums[start + np.arange(many)] = 1.0
        before = slot[pos] - length
        share = np.empty(len(pos))
        some = int(np.searchsorted(-size, -LONG_WORD))  # the first words, that go alone
        apart = int(np.searchsorted(pos, size[:some].sum()))
        share[:apart] = self.shares(rank[pos[:apart]].tolist(), length[:apart].tolist(), weight[:apart].tolist())
        at = rank[pos[apart:]].astype(np.uint16)
        turn = apart + np.argsort(at, kind="stable")
        most = int(size[some]) if some < many else 0
        steps = np.searchsorted(at[turn - apart], np.arange(1, most + 2))
        for j in range(1, most + 1):
            arc = turn[steps[j - 1] : steps[j]]
            part = sums[before[arc]] * weight[arc]
            here = pos[arc]
            first = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
            total = np.add.reduceat(part, first)
            sums[slot[here[first]]] = total
            share[arc] = part / np.repeat(total, np.diff(np.append(first, len(arc))))
            if j % 32 == 0:  # only ratios matter: long words must not run out of range
                tops = slot[start[some : np.searchsorted(-size, -j)] + j - 1]
                near = tops[:, None] - np.arange(min(self.longest, j + 1))
                sums[near] /= sums[tops][:, None]
        last = np.append(pos[1:] != pos[:-1], True)
        opens = np.flatnonzero(np.append(True, last[:-1]))
        run = np.cumsum(share)
        reach = run - np.repeat(run[opens] - share[opens], np.diff(np.append(opens, len(pos))))
        reach[last] = 1
        n = len(pos)
        self.first = grown(self.first, self.nodes + len(text))
        self.reach, self.length, self.piece = (grown(x, self.arcs + n) for x in (self.reach, self.length, self.piece))
        self.first[self.nodes : self.nodes + len(text)] = opens + self.arcs
        room = slice(self.arcs, self.arcs + n)
        self.reach[room], self.piece[room] = reach, ids
        self.length[room] = np.where(rank[pos] == length, 0, length)
        ends = (self.nodes + start + size - 1).tolist()
        self.ends.update(zip(words, ends, strict=True))
        self.alone.update(zip(ends[:some], size[:some].tolist(), strict=True))
        self.arcs += n
        self.nodes += len(text)
        self.held += ARC_BYTES * n + NODE_BYTES * len(text) + WORD_BYTES * many

    def shares(self, ranks: list[int], lengths: list[int], weights: list[float]) -> list[float]:
        """What add() has for the arcs of words that go alone: each arc's probability among those of its last character."""
        out: list[float] = []
        sums, k = [1.0], 0
        while k < len(ranks):
            j, first, part = ranks[k], k, []
            if j == 1:
                sums = [1.0]
            while k < len(ranks) and ranks[k] == j:
                part.append(sums[-lengths[k]] * weights[k])
                k += 1
            total = sum(part)
            out += [x / total for x in part]
            sums = [*sums[-self.longest :], total]
            if j % 32 == 0:
                sums = [x / total for x in sums]
        return out

    def parts(self, word: str) -> Iterator[str]:
        """The runs of a long word between which no piece crosses: its lattice is theirs, one after another."""
        at, wide = 0, AT_ONCE
        while at < len(word):
            some = word[at : at + wide]
            pos, length, _, _ = self.arcs_of(some, np.arange(1, len(some) + 1))
            crossed = np.cumsum(np.bincount(pos - length + 2, minlength=len(some) + 2) - np.bincount(pos + 1, minlength=len(some) + 2))
            cuts = np.flatnonzero(crossed[1 : len(some) + 1] == 0) + 1
            if at + wide < len(word):
                cuts = cuts[cuts <= len(some) - self.longest]  # a piece that ends further on may cross the others
            if not len(cuts):
                wide *= 2
                continue
            ends = cuts.tolist()
            yield from (some[a:b] for a, b in zip([0, *ends], ends, strict=False))
            at, wide = at + ends[-1], AT_ONCE

    def words_of(self, said: str) -> Iterator[str]:
        found = self.pattern.findall(said) if len(said) <= LONG else (m.group() for m in self.pattern.finditer(said))
        if isinstance(found, list) and max(map(len, found), default=0) <= LONG_WORD:
            return iter(found)
        return (x for w in found for x in ([w] if len(w) <= LONG_WORD else self.parts(w)))

    def arcs_of(self, text: str, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """(last character, length, id, weight) of all pieces in a row of words, by last character and the longest, the likeliest, first. rank: place of each character in its word, from 1."""
        codes = code_hashes(text)
        at, one, two = np.arange(len(text)), codes.copy(), codes.copy()
        lone = np.ones(len(text), dtype=bool)
        found = []
        for n, (first, begin, second, piece, weight, maybe) in enumerate(self.tables, 1):
            kind = maybe[one >> np.uint64(47)]
            some = np.flatnonzero(kind & 1)
            if len(some):
                own = one[some]
                k = np.minimum(begin[own >> np.uint64(48)], len(first) - 1)
                left = np.flatnonzero(first[k] < own)
                while len(left):  # few hashes share their top bits
                    k[left] += 1
                    left = left[k[left] < len(first) - 1]
                    left = left[first[k[left]] < own[left]]
                hit = np.flatnonzero((first[k] == own) & (second[k] == two[some]))
                k, some = k[hit], at[some[hit]]
                found.append((some, np.full(len(hit), n), piece[k], weight[k]))
                if n == 1:
                    lone[some] = False
            more = np.flatnonzero((kind & 2 > 0) & (rank[at] > n))  # a run that ends no longer piece is not followed further
            if not len(more):
                break
            at, one, two = at[more], one[more], two[more]
            own = codes[at - n]
            one += own * np.uint64(pow(FACTORS[0], n, 1 << 64))
            two += own * np.uint64(pow(FACTORS[1], n, 1 << 64))
        lone = np.flatnonzero(lone)
        spelt = np.fromiter((self.spell(text[k]) for k in lone), dtype=np.int32, count=len(lone))
        found.insert(0, (lone, np.ones(len(lone), dtype=np.int64), spelt, np.full(len(lone), self.rare)))
        columns = [np.concatenate(c) for c in zip(*found[::-1], strict=True)]
        order = np.argsort(columns[0].astype(np.uint16 if len(text) < 1 << 16 else np.int64), kind="stable")
        return tuple(c[order] for c in columns)

    def learn(self, words: set[str]) -> None:
        some, n = [], 0
        for w in words:
            some.append(w)
            n += len(w)
            if n >= AT_ONCE:
                self.add(some)
                some, n = [], 0
        if some:
            self.add(some)

    def sample(self, texts: list[str], keys: list[int], seed: int) -> list[np.ndarray]:
        """Piece ids of each text, drawn by its key."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        words: list[str] = []
        runs: list[tuple[int, int, int]] = []  # (text, place of its first word, words) of what is open

        def flush() -> None:
            for (k, _, _), ids in zip(runs, self.sample_words(words, [(keys[k], first, n) for k, first, n in runs], seed), strict=True):
                out[k].append(ids)
            words.clear()
            runs.clear()

        for k, text in enumerate(texts):
            said = " " + text if text else ""
            found = self.words_of(said)
            first = 0
            while some := list(islice(found, WORDS_AT_ONCE - len(words))):
                words += some
                runs.append((k, first, len(some)))
                first += len(some)
                if len(words) >= WORDS_AT_ONCE:
                    flush()
        flush()
        return [x[0] if len(x) == 1 else np.concatenate([np.empty(0, dtype=np.int32), *x]) for x in out]

    def sample_words(self, words: list[str], runs: list[tuple[int, int, int]], seed: int) -> list[np.ndarray]:
        """Piece ids of each run of words: (key, place of its first word, words)."""
        if self.held > REMEMBERED:
            self.forget()
        many = np.array([n for _, _, n in runs], dtype=np.int64)
        node = np.fromiter(map(self.ends.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(node < 0)
        new = [words[k] for k in unknown]
        self.learn(set(new))
        node[unknown] = np.fromiter(map(self.ends.__getitem__, new), dtype=np.int64, count=len(new))
        place = np.arange(len(node)) - np.repeat(np.cumsum(many) - many - np.array([first for _, first, _ in runs], dtype=np.int64), many)
        keys = np.array([k & WORD64 for k, _, _ in runs], dtype=np.uint64)
        key = np.repeat(mixed(keys + np.uint64((hash_of(seed) + 0x9E3779B97F4A7C15) & WORD64)), many)  # hash_of(seed, k)
        draw = mixed(key + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, depth = [], np.zeros(len(node), dtype=np.int64)
        alone = np.isin(node, list(self.alone)) if self.alone else np.zeros(len(node), dtype=bool)
        walked = {int(w): self.walk(int(node[w]), int(draw[w])) for w in np.flatnonzero(alone)}
        for w, back in walked.items():
            depth[w] = len(back)
        of = np.flatnonzero(~alone)
        node, draw = node[of], draw[of]
        steps = []
        while len(of):
            draw = mixed(draw + np.uint64(STRIDE))
            arc = self.drawn(node, (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)
            steps.append(of.astype(np.int32))
            ids.append(self.piece[arc])
            depth[of] += 1
            back = self.length[arc]
            left = np.flatnonzero(back)
            of, node, draw = of[left], node[left] - back[left], draw[left]
        start = np.cumsum(depth) - depth
        out = np.empty(int(depth.sum()), dtype=np.int32)
        for k, (w, p) in enumerate(zip(steps, ids, strict=True)):
            out[start[w] + depth[w] - 1 - k] = p
        for w, back in walked.items():
            out[start[w] : start[w] + depth[w]] = back[::-1]
        cuts = np.concatenate(([0], np.cumsum(depth)))[np.concatenate(([0], np.cumsum(many)))]
        out, cuts = self.expanded(out, cuts)
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def walk(self, node: int, draw: int) -> list[int]:
        """Pieces of a word that goes alone, backwards, by the draws that lockstep would make."""
        low = node + 1 - self.alone[node]
        begin = int(self.first[low])
        end = int(self.first[node + 1]) if node + 1 < self.nodes else self.arcs
        first = (self.first[low : node + 1] - begin).tolist()
        reach, length, piece = (x[begin:end].tolist() for x in (self.reach, self.length, self.piece))
        at, out = node - low, []
        while True:
            draw = (draw + STRIDE) & WORD64
            draw = ((draw ^ draw >> 30) * 0xBF58476D1CE4E5B9) & WORD64
            draw = ((draw ^ draw >> 27) * 0x94D049BB133111EB) & WORD64
            draw ^= draw >> 31
            u, arc = (draw >> 11) * 2.0**-53, first[at]
            while reach[arc] <= u:
                arc += 1
            out.append(piece[arc])
            if not length[arc]:
                return out
            at -= length[arc]

    def drawn(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each node at which the cumulative probability passes u."""
        arc = self.first[node]
        left = np.flatnonzero(self.reach[arc] <= u)
        while len(left):
            arc[left] += 1
            left = left[self.reach[arc[left]] <= u[left]]
        return arc

    def expanded(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Numbers of spellings replaced by their byte pieces, and where the same texts are cut then."""
        far = np.flatnonzero(ids >= self.size)
        if not len(far):
            return ids, cuts.tolist()
        spelt = [self.spellings[k - self.size] for k in ids[far].tolist()]
        many = np.ones(len(ids), dtype=np.int64)
        many[far] = list(map(len, spelt))
        ends = np.concatenate(([0], np.cumsum(many)))
        out = np.repeat(ids, many)
        out[spans(ends[far], many[far])] = list(chain.from_iterable(spelt))
        return out, ends[cuts].tolist()


@lru_cache(maxsize=2)
def lattice(model: bytes, sharpness: float) -> Lattice:
    return Lattice(model, sharpness)


@lru_cache(maxsize=2)
def spelt_pieces(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length) of what each piece stands for; no bytes for those that stand for no text."""
    spelt = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind == NORMAL else b"" for p, kind in vocabulary(model)]
    size = np.array([len(x) for x in spelt], dtype=np.int64)
    return np.frombuffer(b"".join(spelt), dtype=np.uint8), np.cumsum(size) - size, size


def decoded_bytes(model: bytes, ids: np.ndarray, ends: np.ndarray | None = None) -> list[bytes]:
    """The UTF-8 texts that were encoded, whose pieces end at `ends` (one text by default); the space put before each is left out."""
    spelt, start, size = spelt_pieces(model)
    parts, at, place = [], 0, [0]
    ends = np.array([len(ids)]) if ends is None else ends
    for low in range(0, len(ids), 1 << 15):
        some = ids[low : low + (1 << 15)]
        many = size[some]
        parts.append(spelt[spans(start[some], many)].tobytes())
        inside = ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, low + len(some), side="right")]
        place += (at + np.cumsum(many)[inside - low - 1]).tolist()
        at += len(parts[-1])
    place = [0] * int(np.searchsorted(ends, 0, side="right")) + place
    whole = b"".join(parts)
    return [whole[a + 1 : b] for a, b in zip(place, place[1:], strict=False)]


def decoded(model: bytes, ids: list[int] | np.ndarray) -> str:
    return decoded_bytes(model, np.asarray(ids, dtype=np.int64))[0].decode("utf-8", errors="replace")


# ---------------------------------------------------------------- distributed


def encode(docs: DataFrame, key: Column | None = None, path: str | None = None, seed: int = 1, sharpness: float = SHARPNESS) -> DataFrame:
    """docs with pieces array<int>. key (doc_id by default; null counts as -1) seeds a row's draws; equal keys and texts give equal pieces.

    Null texts give null, empty ones an empty array. Rows keep their number; a column named pieces is replaced.
    """
    return sampled(docs, docs.drop("pieces").columns, key, path, seed, sharpness, ["pieces"])


def sampled(docs: DataFrame, keep: list[str], key: Column | None, path: str | None, seed: int, sharpness: float, wanted: list[str]) -> DataFrame:
    """The columns `keep` of docs, then by name: pieces; decoded_sha256, the digest of what the pieces decode to; lossless, whether that is the very text. The text comes back from the workers only if it is kept."""
    model = model_bytes(path)
    kept = [F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)]  # so that no name clashes
    seeded = F.coalesce((F.col("doc_id") if key is None else key).cast("long"), F.lit(-1))
    keyed = docs.select(*kept, F.col("text").cast("string").alias("text"), seeded.alias("seed"))
    kinds = {"pieces": T.ArrayType(T.IntegerType()), "decoded_sha256": T.StringType(), "lossless": T.BooleanType()}
    names = [f"k{n}" for n in range(len(keep))]

    def run(batches: Batches) -> Batches:
        own = lattice(model, sharpness)
        for batch in batches:
            for part in slices(batch, TEXTS_AT_ONCE):
                said = part.column(len(names)).to_pylist()
                found = own.sample([x or "" for x in said], part.column(len(names) + 1).to_pylist(), seed)
                more: dict[str, pa.Array] = {}
                ends, flat = np.cumsum([0, *map(len, found)]), np.concatenate([np.empty(0, dtype=np.int32), *found])
                if "pieces" in wanted:
                    more["pieces"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array([x is None for x in said]))
                if len(wanted) > 1:
                    back = [None if x is None else y for x, y in zip(said, decoded_bytes(model, flat, ends[1:]), strict=True)]
                    more["decoded_sha256"] = pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in back], type=pa.string())
                    more["lossless"] = pa.array([None if x is None else x == y.encode() for x, y in zip(back, said, strict=True)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *(more[w] for w in wanted)], names=[*names, *wanted])
        own.clear()  # what was learnt would stay beside other workers' memory

    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)]
    made = keyed.mapInArrow(lean(run), T.StructType([*fields, *(T.StructField(w, kinds[w]) for w in wanted)]))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *wanted)


def decode(coded: DataFrame, path: str | None = None, name: str = "decoded") -> DataFrame:
    """coded with the text of its pieces; null for null."""
    model = model_bytes(path)
    coded = coded.drop(name)
    at = coded.columns.index("pieces")

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch, 4 << 20):
                said = [None if not x.is_valid else decoded(model, x.values.to_numpy(zero_copy_only=False)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, type=pa.string())], names=[*part.schema.names, name])

    return coded.mapInArrow(lean(run), T.StructType([*coded.schema.fields, T.StructField(name, T.StringType())]))


def checked(docs: DataFrame, keep: list[str] | None = None, path: str | None = None, seed: int = 1) -> DataFrame:
    """The columns `keep` of docs (all by default) with pieces, decoded_sha256 and lossless: whether the pieces decode to the very text, by decoding them. Null texts give nulls."""
    wanted = ["pieces", "decoded_sha256", "lossless"]
    return sampled(docs, docs.drop(*wanted).columns if keep is None else keep, None, path, seed, SHARPNESS, wanted)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_pieces, pieces_xxh64, decoded_sha256, lossless, of every row; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    found = checked(docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")), ["doc_id", "n_bytes"], path)
    return found.select("doc_id", "n_bytes", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_xxh64"), "decoded_sha256", "lossless")
