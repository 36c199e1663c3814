"""N-gram Jaccard join by PartEnum signatures (operator 10).

Each text becomes the set of its distinct word shingles, hashed to 64 bits. Sets are put into overlapping size
bands. Sets of one band that are similar enough differ in at most k shingles; the shingle domain is cut into n1
parts of n2 pieces, and every part gives one signature for each way of leaving out k2 of its pieces. n1 is so
large that in at least one part at most k2 shingles differ, hence similar sets share a signature. Agreeing on an
empty piece gives none: there are spare parts for that, and a set with more empty parts than spare ones signs
those too. Where that needs too many parts (k of 40 or more, and middle k at low similarities) fewer spare parts
stand than could be empty: a pair at the very threshold then hangs on chance, since its differences fall on the
pieces at random and leave more than a quarter of them alone, and all of those would have to be empty ones. That
chance is below 1e-12 for k of 40 or more and about 1e-7 for the middle k, for a pair with no difference to spare.
Measured at the very threshold, 400 pairs each of 30 to 1,000 shingles and 100 each of 2,000 and 4,000, at similarities
0.9 and 0.8: no pair was lost.

Work on the signatures never pairs a whole group:
1. equal sets are one class, found by a 128-bit key; only its smallest id goes on;
2. within each Arrow batch, then after one shuffle, a signature's members are tied to one hub by a star of
   candidate pairs (so a hot signature arrives as one row per batch);
3. candidates pass a safe filter, the L1 distance of 64 bucket counts, which never exceeds the true difference,
   and are then verified on the texts;
4. groups that their hub did not put into one component get the best linked member as a second hub;
5. what is still apart is compared member by member in blocks of bounded size, different components only. This
   makes the result exact for every input; no group is capped. Pairs are told apart in place, by a second safe filter
   that knows the difference almost to the shingle: the differing bits of odd sketches that grow with the sets. So
   only pairs at the threshold are listed and go on to the texts, not the square of a group.

Defined results: null and empty texts have no shingles and are linked with nothing; a text of fewer words than
a shingle is one shingle; rows of the same id are one document with links of each; a null id stays a row of its
own without component; empty tables give empty tables; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, id_text, join_hot, scratch, split_by_ids, stored, text_blocks, tidy
from .components import components
from .hashing import Words, mix

#: Width of a size band: the largest size over the smallest.
BAND = 1.25
#: Shingles that a signature must cover on average, for the smallest set of a band.
SHARED = 3.5
#: Buckets of the filter's counts.
BUCKETS = 64
#: Bits of an odd sketch for each shingle, at least, and bits of one at most (16 KB; larger sets only pass more pairs).
ODD_BITS, MOST_ODD_BITS = 4, 1 << 17
#: Members compared with each other at once in the exact pass.
BLOCK = 256
#: Texts that are verified against one copy of their hub's.
MEMBERS = 512

_P = 0x9E3779B97F4A7C15
_U = np.uint64
#: Odd factors of the places in a shingle and of the pieces in a signature; unrelated, so that no two orders of
#: the same words sum up alike.
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * _U(_P)) | _U(1)


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    found = Words(texts)
    words, starts = found.hashes, found.starts
    count = np.diff(starts)
    combined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        combined += words[j : j + len(combined)] * _FACTORS[j]
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    owner = np.repeat(np.arange(len(n)), n)
    at = starts[:-1][owner] + np.arange(offsets[-1]) - offsets[:-1][owner]
    whole = count[owner] >= width
    out = np.zeros(len(at), np.uint64)
    out[whole] = combined[at[whole]]
    for i in np.flatnonzero((count > 0) & (count < width)).tolist():
        part = words[starts[i] : starts[i + 1]]
        out[offsets[i]] = (part * _FACTORS[: len(part)]).sum(dtype=np.uint64) + _U(len(part))
    out = mix(out)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[offsets[:-1][n > 0]] = True
    kept = np.concatenate(([0], np.cumsum(new)))
    return out[new], kept[offsets]


class Bands:
    """Size bands and their PartEnum parameters for a similarity of percent / 100."""

    def __init__(self, percent: int, largest: int):
        self.percent, lows, self.parameters = percent, [1], []
        while lows[-1] <= largest:
            high = max(lows[-1], int(lows[-1] * max(BAND, 100 / percent)))
            self.parameters.append(self._parameters(lows[-1], high))
            lows.append(high + 1)
        self.low = np.array(lows[:-1], np.int64)

    def _parameters(self, low: int, high: int) -> tuple[int, int, int, int]:
        """(n1, n2, k2, spare): parts, pieces of a part, pieces left out, parts that may agree on nothing."""
        k = (100 - self.percent) * 2 * high // (100 + self.percent)
        if k == 0:
            return 0, 0, 0, 0
        if k <= 2:
            return 1, 3 + k, k, 0
        if k >= 40:  # chance takes the place of spare parts: see the module's text
            return k // 2 + 1, 2, 1, int(0.3 * (k // 2 + 1))
        smallest, best = low * self.percent / 100, None
        for n2, k2 in ((2, 1), (3, 1), (4, 1), (4, 2), (5, 2), (6, 3)):
            spare = 0 if k <= 12 and n2 - k2 >= 2 else 1
            for _ in range(60):
                n1 = k // (k2 + 1) + 1 + spare
                empty = n1 * n2 * math.exp(-smallest * (n2 - k2) / n2 / n1) if spare else 0
                wanted = math.ceil(1 + empty + 3 * math.sqrt(empty)) if spare else 0
                if wanted <= spare:
                    break
                spare = wanted
            else:
                continue
            shared = smallest * (n2 - k2) / n2 / n1
            if shared >= SHARED and (best is None or n1 * math.comb(n2, k2) < best[0]):
                best = n1 * math.comb(n2, k2), (n1, n2, k2, spare)
        return best[1] if best else (k // 2 + 1, 3, 1, 3)

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def signatures(sets: np.ndarray, offsets: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, signature) of all sets."""
    size = np.diff(offsets)
    own = bands.of(np.maximum(size, 1))
    indexes, signs = [], []
    for band in np.unique(np.concatenate((own[size > 0], own[size > 0] + 1))).tolist():
        if band >= len(bands.parameters):
            continue
        n1, n2, k2, spare = bands.parameters[band]
        low = int(bands.low[band])
        chosen = np.flatnonzero((size > 0) & ((own == band) | ((own == band - 1) & (size * 100 >= low * bands.percent))))
        if not n1 or not len(chosen):
            continue
        n = size[chosen]
        owner = np.repeat(np.arange(len(chosen)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        h = sets[offsets[:-1][chosen][owner] + inner]
        pieces = n1 * n2
        piece = owner * pieces + ((h >> _U(20)) % _U(pieces)).astype(np.int64)
        total = np.zeros(len(chosen) * pieces, np.uint64)
        np.add.at(total, piece, mix(h + _U((_P * (band + 1)) & (2**64 - 1))))
        filled = (np.bincount(piece, minlength=len(total)) > 0).reshape(len(chosen), n1, n2)
        total = total.reshape(len(chosen), n1, n2)
        made, full = [], []
        for left in itertools.combinations(range(n2), n2 - k2):
            value = np.zeros(total.shape[:2], np.uint64)
            for j in left:
                value += total[:, :, j] * _FACTORS[j]
            salt = mix(np.arange(n1, dtype=np.uint64) + _U(band * 1_000_003 + sum(1 << j for j in left) * 7_919_000_017))
            made.append(mix(value + salt))
            full.append(filled[:, :, list(left)].any(axis=2))
        made, full = np.stack(made, axis=2), np.stack(full, axis=2)
        # agreeing on nothing counts only for sets with more such parts than the spare ones
        bare = (~full).any(axis=2).sum(axis=1) > spare
        use = full | bare[:, None, None]
        indexes.append(np.repeat(chosen, use.reshape(len(chosen), -1).sum(axis=1)))
        signs.append(made[use])
    if not indexes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(indexes), np.concatenate(signs)


SETS = "doc_id long, n_shingles long, key1 long, key2 long, counts binary, odd binary"


def _keys(sets: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, whatever the order of its shingles."""
    owner = np.repeat(np.arange(len(size)), size)
    key1, key2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    np.add.at(key1, owner, mix(sets + _U(1)))
    np.add.at(key2, owner, mix(sets + _U(2)))
    return key1, key2


def odd_sketch(shingles: np.ndarray) -> bytes:
    """A bit for each bucket of a set: whether it holds an odd number of shingles. Of two sketches of one length as many
    bits differ as shingles do at most; the longer one, a power of 2, folds to the length of the other."""
    bits = 64
    while bits < min(ODD_BITS * len(shingles), MOST_ODD_BITS):
        bits *= 2
    at = ((shingles >> _U(24)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(words: np.ndarray, length: int) -> np.ndarray:
    """The rows of a matrix of sketches in 64-bit words, each folded to a number of words."""
    while words.shape[1] > length:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


class OddSketches:
    """The sketches of a block's members, by length."""

    def __init__(self, sketches: list[bytes]):
        size = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
        self.size, self.row, self.words = size, np.zeros(len(size), np.int64), {}
        for n in np.unique(size).tolist():
            own = np.flatnonzero(size == n)
            self.row[own] = np.arange(len(own))
            self.words[n] = np.frombuffer(b"".join([sketches[i] for i in own.tolist()]), "<u8").reshape(-1, n)

    def apart(self, x: int, to: np.ndarray) -> np.ndarray:
        """How many shingles member x and each of `to` differ in, at least."""
        out, n = np.zeros(len(to), np.int64), int(self.size[x])
        own = self.words[n][self.row[x] : self.row[x] + 1]
        for m in np.unique(self.size[to]).tolist():
            at = np.flatnonzero(self.size[to] == m)
            least = min(n, m)
            differ = _folded(self.words[m][self.row[to[at]]], least) ^ _folded(own, least)
            out[at] = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
        return out


def set_table(docs: DataFrame, width: int) -> DataFrame:
    """Per document: the size and 128-bit key of its shingle set, its bucket counts and its odd sketch."""

    def run(batches):
        for block, texts in text_blocks(batches, "text"):
            sets, offsets = shingle_sets(texts, width)
            size = np.diff(offsets)
            key1, key2 = _keys(sets, size)
            owner = np.repeat(np.arange(len(size)), size)
            counts = np.bincount(owner * BUCKETS + (sets & _U(BUCKETS - 1)).astype(np.int64), minlength=len(size) * BUCKETS)
            counts = np.minimum(counts, 65535).astype("<u2").reshape(len(size), BUCKETS)
            odd = [odd_sketch(sets[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [block.column(0), pa.array(size), pa.array(key1.view(np.int64)), pa.array(key2.view(np.int64)), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "key1", "key2", "counts", "odd"])

    return docs.mapInArrow(run, SETS)


STARS = "sig long, a long, b long"


def _stars(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (sig, id): whether each row is its signature's first, and that first row's id."""
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    return first, ids[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))], sig


def candidate_stars(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, a, b): for each signature of several sets, its members b, each with a hub a.

    Of equal sets in a block only the first makes signatures."""

    def local(batches):
        bands = None
        for block, texts in text_blocks(batches, "text"):
            sets, offsets = shingle_sets(texts, width)
            size = np.diff(offsets)
            key1, key2 = _keys(sets, size)
            chosen = np.sort(np.unique(np.stack((key1, key2, size.astype(np.uint64)), axis=1), axis=0, return_index=True)[1])
            used = np.zeros(len(size), bool)
            used[chosen] = size[chosen] > 0
            sets = sets[np.repeat(used, size)]
            offsets = np.concatenate(([0], np.cumsum(size[used])))
            if bands is None or bands.low[-1] <= size.max(initial=1) * 2:
                bands = Bands(percent, int(size.max(initial=1)) * 4)
            index, sig = signatures(sets, offsets, bands)
            ids, sig = block.column(0).to_numpy(zero_copy_only=False)[used][index], sig.view(np.int64)
            order = np.lexsort((ids, sig))
            sig, ids = sig[order], ids[order]
            first, hub, _ = _stars(sig, ids)
            for part in range(0, len(sig), 200_000):
                cut = slice(part, part + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(sig[cut]), pa.array(ids[cut]), pa.array(hub[cut], mask=first[cut])], ["sig", "id", "hub"])

    def runs(batches):
        held = None  # the last signature's hub in the batch before
        for batch in batches:
            sig, ids, hub = (batch.column(i) for i in range(3))
            sig, ids = sig.to_numpy(), ids.to_numpy()
            tied = hub.is_valid().to_numpy(zero_copy_only=False)
            if tied.any():
                old = np.flatnonzero(tied)
                yield pa.RecordBatch.from_arrays([pa.array(sig[old]), hub.take(pa.array(old)), pa.array(ids[old])], ["sig", "a", "b"])
            sig, ids = sig[~tied], ids[~tied]
            if not len(sig):
                continue
            first, hubs, _ = _stars(sig, ids)
            if held is not None and held[0] == sig[0]:
                head = np.flatnonzero(sig == sig[0])
                hubs[head], first[0] = held[1], False
            held = (sig[-1], hubs[-1])
            if not first.all():
                yield pa.RecordBatch.from_arrays([pa.array(sig[~first]), pa.array(hubs[~first]), pa.array(ids[~first])], ["sig", "a", "b"])

    rows = docs.mapInArrow(local, "sig long, id long, hub long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, F.when(F.col("hub").isNull(), F.col("sig")).otherwise(F.xxhash64("id")))
    return dealt.sortWithinPartitions("sig", "id").mapInArrow(runs, STARS).where("a <> b")


def close_enough(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bucket counts leave the similarity possible."""
    side = sets.select("doc_id", "n_shingles", "counts")
    both = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("counts").alias("ca")), "a").join(
        side.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("counts").alias("cb")), "b"
    )

    def run(batches):
        for batch in batches:
            a, b, na, ca, nb, cb = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "na", "ca", "nb", "cb"))
            keep = possible(na.to_numpy(), _matrix(ca), nb.to_numpy(), _matrix(cb), percent)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], ["a", "b"])

    return both.select("a", "b", "na", "ca", "nb", "cb").mapInArrow(run, "a long, b long")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BUCKETS).astype(np.int32)


def possible(na, ca, nb, cb, percent: int) -> np.ndarray:
    """A saturated count makes the distance smaller, never larger, so no similar pair is lost."""
    apart = np.abs(ca - cb).sum(axis=1)
    return (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent) & (apart * (100 + percent) <= (100 - percent) * (na + nb))


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets, made from the whole texts again, are similar enough.

    Each b's text is sent once a pair to its hub a; the hub's own is sent once for every MEMBERS of them, which are a
    slot of their own, so that no hub gathers more in one place. A task holds a hub's set and streams its members."""
    if pairs.isEmpty():
        return pairs
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    texts = split_by_ids(docs.where("doc_id is not null").select("doc_id", "text"), F.col("doc_id"), ids)[0]
    hubs = stored(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("slots", F.ceil(F.col("n") / MEMBERS).cast("int")))
    slotted = join_hot(pairs, hubs.select("a", "slots"), ["a"], hot_keys(hubs, ["a"])).select("a", F.pmod(F.xxhash64("b"), "slots").cast("int").alias("slot"), F.lit(1).alias("kind"), F.col("b").alias("doc_id"))
    own = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(0).alias("kind"), F.col("a").alias("doc_id"))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = slotted.unionByName(own).join(texts, "doc_id").repartition(parts, "a", "slot").sortWithinPartitions("a", "slot", "kind", "doc_id")

    def run(batches):
        key, held = None, []
        for block, texts_ in text_blocks(batches, "text"):
            sets, offsets = shingle_sets(texts_, width)
            a, slot, kind, b = (block.column(c).to_pylist() for c in range(4))
            keep = []
            for row in range(len(a)):
                own_set = sets[offsets[row] : offsets[row + 1]]
                if (a[row], slot[row]) != key:
                    key, held = (a[row], slot[row]), []
                if kind[row] == 0:
                    held.append(own_set.copy())
                elif any(_similar(hub, own_set, percent) for hub in held):
                    keep.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([a[r] for r in keep], pa.int64()), pa.array([b[r] for r in keep], pa.int64())], ["a", "b"])

    return rows.select("a", "slot", "kind", "doc_id", "text").mapInArrow(run, "a long, b long").distinct()


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Of two sorted sets."""
    if not len(p) or not len(q) or min(len(p), len(q)) * 100 < max(len(p), len(q)) * percent:
        return False
    shared = int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def _grouped(stars: DataFrame, linked: DataFrame) -> DataFrame:
    """(sig, id, component, n) of signatures that hold three members or more in several components; n: members."""
    members = stars.select("sig", F.col("a").alias("id")).union(stars.select("sig", "b")).distinct()
    known = stored(members.join(linked, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component")))
    open_ = stored(known.groupBy("sig").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("n > 2 and x <> y").select("sig", "n"))
    return stored(join_hot(known, open_, ["sig"], hot_keys(open_, ["sig"])))


def _second_hubs(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b): each open group's member with most links, and its members of other components."""
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = stored(groups.join(degree, "id", "left").select("sig", "id", "component", F.coalesce("degree", F.lit(0)).alias("degree")))
    hub = stored(ranked.groupBy("sig").agg(F.max_by(F.struct("id", "component"), F.struct("degree", -F.col("id"))).alias("hub"), F.count("*").alias("n")))
    met = join_hot(ranked, hub.drop("n"), ["sig"], hot_keys(hub, ["sig"]))
    return met.where("component <> hub.component").select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct()


def _block_pairs(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of an open group's members in different components that both filters let pass, found
    block against block."""
    side = sets.select(F.col("doc_id").alias("id"), "n_shingles", "counts", "odd")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    spread = groups.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).join(side, "id")
    keyed = spread.groupBy("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("id", "component", "own", "n_shingles", "counts", "odd")).alias("members"))

    def run(batches):
        for batch in batches:
            for i, j, members in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                ids, comp, own_ = (np.array([m[k] for m in members], np.int64) for k in ("id", "component", "own"))
                n = np.array([m["n_shingles"] for m in members], np.int64)
                counts = np.frombuffer(b"".join(m["counts"] for m in members), "<u2").reshape(-1, BUCKETS).astype(np.int32)
                odd = OddSketches([m["odd"] for m in members])
                for x in np.flatnonzero(own_ == i).tolist():
                    to = np.flatnonzero((own_ == j) & (comp != comp[x]) & ((ids > ids[x]) if i == j else True))
                    if len(to):
                        to = to[possible(n[x], counts[x], n[to], counts[to], percent)]
                    if len(to):
                        to = to[odd.apart(x, to) * (100 + percent) <= (100 - percent) * (n[x] + n[to])]
                    if len(to):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[to])), pa.array(np.maximum(ids[x], ids[to]))], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest id reachable by links of similarity percent / 100."""
    docs = id_text(docs, id_col, text_col)
    every = stored(set_table(docs, width))
    usable = every.where("n_shingles > 0 and doc_id is not null")
    # equal sets are one class
    key = ["key1", "key2", "n_shingles"]
    classes = stored(usable.groupBy(*key).agg(F.min("doc_id").alias("chief"), F.count("*").alias("n")).where("n > 1"))
    members = join_hot(usable.select("doc_id", *key), classes.select(*key, "chief"), key, hot_keys(classes, key))
    copies = stored(members.where("doc_id <> chief").select("doc_id", "chief").distinct())
    stars = candidate_stars(docs.where("doc_id is not null"), width, percent)
    for end in ("a", "b"):
        of = copies.select(F.col("doc_id").alias(end), F.col("chief").alias(f"{end}_chief"))
        stars = stars.join(of, end, "left").withColumn(end, F.coalesce(f"{end}_chief", end)).drop(f"{end}_chief")
    stars = stored(stars.where("a <> b").select("sig", "a", "b"))
    sets = usable.select("doc_id", "n_shingles", "counts", "odd")

    def links_of(pairs: DataFrame) -> DataFrame:
        found = stored(verified(stored(close_enough(pairs.distinct(), sets, percent)), docs, width, percent))
        tidy(docs.sparkSession)
        return found

    links = links_of(stars.select("a", "b"))
    groups = _grouped(stars, components(links))
    for more in (_second_hubs, None):
        if groups.isEmpty():
            break
        found = links_of(_second_hubs(groups, links) if more else _block_pairs(groups, sets, percent))
        links = links.union(found)
        if more:
            groups = _grouped(stars, components(links))
    whole = components(links.union(copies.select(F.col("doc_id").alias("a"), F.col("chief").alias("b"))))
    return every.join(whole.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that link to one of smaller id, however far; a repeated id stays
    once. Texts without words and rows of a null id all stay."""
    with scratch(docs.sparkSession):
        found = stored(near_duplicates(docs, width, percent, id_col, text_col), outlives=True)
    found = found.where("n_shingles > 0 and doc_id is not null")
    losers = found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"))
    key = F.col(id_col).cast("long")
    some, rest = split_by_ids(docs, key, losers.union(twice))
    named = some.where(F.col(id_col).isNotNull())
    kept = named.join(losers, key == F.col("id"), "left_anti").dropDuplicates([id_col])
    return kept.unionByName(some.where(F.col(id_col).isNull())).unionByName(rest)


#: The same components in SQL, for the registered query's 3-word shingles and 90 percent.
SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda k: array_to_string(list_slice(w, k, k + 2), ' '))) END AS s FROM t),
u AS (SELECT s, min(doc_id) AS chief, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL) GROUP BY s),
e AS (SELECT row_number() OVER () AS k, chief, n, unnest(s) AS sh FROM u),
pairs AS (SELECT a.chief AS a, b.chief AS b FROM e a JOIN e b ON a.sh = b.sh AND a.chief <> b.chief AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.chief, b.chief, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(id, c) AS (SELECT chief, chief FROM u UNION SELECT pairs.b, r.c FROM r JOIN pairs ON pairs.a = r.id WHERE r.c < pairs.b),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id FROM s LEFT JOIN u ON u.s = list_sort(s.s) AND s.doc_id IS NOT NULL LEFT JOIN m ON m.id = u.chief
"""
