"""Similarity join of documents on their sets of word shingles: Jaccard 0.75 or more, by universe partitioning.

Two sets of a and b shingles link iff they differ in at most H = (a + b) / 7 shingles. The hash universe is cut into m
equal ranges (segments), m set by the band of sizes (powers of two) of the smaller set; every set is signed under its own
band, and under the band below if it can be the larger partner there. By the pigeonhole principle, a set with more than H
segments that are not empty shares one of them, whole, with any partner.

Which signatures a set needs is allocated by cost:

* level 0: every segment with a rare shingle, each good for one difference. Shingles of very frequent passages are known
  from a frequency summary over all documents (Misra-Gries), and segments made of them alone are left out. A set is
  covered if more than H segments remain;
* level 1, for sets that level 0 doesn't cover: fewer, larger segments, with the segment itself and its one-deletion
  neighbourhood, good for two differences;
* level 2, for what is left (tiny sets): every shingle.

A pair with one covered member is found at that member's level, as both members sign every level up to their own. So no
link is lost, whatever the frequency summary says; it only sets the cost. Once the runs of equal signatures are known, their
measured lengths allocate again: a covered set keeps its H + 1 cheapest signatures and leaves the longest runs.

Signatures travel as records of 12 bytes packed by hash bucket; there is a bucket for every SHINGLES_PER_BUCKET shingles. A run
yields a star of pairs, not all pairs. Candidates pass the size bound and a lower bound of the difference (parities of hashed
positions), and are then verified on the words themselves. Links make components; runs that still hold several components are
gathered into families of near copies, and only what the first search left outside a family's largest component is compared
with the family, in blocks, with the same filter. So the components are exact.

Exact copies share a class from the start. Hot groups: classes are aggregated with map-side combination, runs of any size are
stars or blocks, and nothing but sums, a bitmap of at most 2^BITMAP_BITS bits (a join beyond that) and at most MAX_FREQUENT shingle
hashes reaches the driver. What isn't split: the records of one signature, 12 bytes a class and task, meet in one bucket.
Texts are read in parts of half a megabyte, and hashed in blocks, so memory follows the words of the longest text.

Edge cases: null, empty and blank texts have no shingles, and are components of their own; repeated rows are one class; rows
with a null id take their class's component, null if the class has no id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import batch_bytes, col, connected_components, dropped, few_files, fresh, sliced, small, table, written
from .shingles import exact_set, mix, shingle_sets

#: A shingle in more than FREQUENT documents is frequent; at most MAX_FREQUENT of them are told to the tasks.
FREQUENT, MAX_FREQUENT, SUMMARY = 64, 200_000, 100_000
#: Runs up to SMALL_RUN members yield all their pairs; larger ones are stars. Block side of the second search.
SMALL_RUN, BLOCK = 3, 512
SHINGLES_PER_BUCKET, RECORDS_PER_FLUSH, BITMAP_BITS = 250_000, 500_000, 26
#: Bytes of a signature record; steps of the logarithm of a size in it, and how many of them two linked sets may be apart.
RECORD, SIZE_STEPS, SIZE_REACH = 12, 5, 3
#: Class ids a task remembers as signed, and nodes its link forest holds, before it starts afresh.
MAX_SIGNED, MAX_FOREST = 1 << 18, 1 << 20
_U = np.uint64
_SALTS = [_U(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, 3)]




def _parities(hashes: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Per set: parity of the number of hashes at each of B positions, B the power of two at or above four times the size, 64 at least."""
    bits = 1 << np.maximum(6, 2 + np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = base[owner] + (hashes & (bits[owner] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(bool), bitorder="little")
    return [packed[a // 8:b // 8].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def _differences(a: bytes, b: bytes) -> int:
    """At least so many shingles differ between two sets with these parities."""
    if len(a) > len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    bits = 8 * len(b)
    while bits > 8 * len(a):
        bits //= 2
        y = (y >> bits) ^ (y & ((1 << bits) - 1))
    return (x ^ y).bit_count()


class Frequent:
    """Misra-Gries summary of shingle hashes: counts are low by at most what was subtracted."""

    def __init__(self, size: int = SUMMARY):
        self.size, self.keys, self.counts, self.waiting, self.n = size, np.zeros(0, _U), np.zeros(0, np.int64), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.n += len(hashes)
        if self.n > 8 * self.size:
            self.settle()

    def settle(self) -> None:
        fresh_, counts = np.unique(np.concatenate([np.zeros(0, _U), *self.waiting]), return_counts=True)
        self.waiting, self.n = [], 0
        keys, where = np.unique(np.concatenate([self.keys, fresh_]), return_inverse=True)
        total = np.bincount(where, np.concatenate([self.counts, counts])).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        if len(keys) > self.size:
            cut = np.partition(total, len(total) - self.size - 1)[len(total) - self.size - 1]
            keys, total = keys[total > cut], total[total > cut] - cut
        self.keys, self.counts = keys, total


def _sets(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, n, cid, cid2, par); and per task one row (frequent) with its frequent shingles, packed."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("cid2", pa.int64()), ("par", pa.binary()), ("frequent", pa.binary())])

    def run(batches):
        seen = Frequent()
        for part in sliced(batches, 1):
            hashes, offs = shingle_sets(part.column(1))
            seen.add(hashes)
            sizes = np.diff(offs)
            sums = np.concatenate([np.zeros((2, 1), _U), np.cumsum(np.stack([mix(hashes), mix(hashes ^ _U(0x5851F42D4C957F2D))]), axis=1, dtype=_U)], 1)
            one, two = (mix(s[offs[1:]] - s[offs[:-1]]).view(np.int64) for s in sums)
            nothing = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(one), pa.array(two), pa.array(_parities(hashes, offs, sizes), pa.binary()), nothing], schema=schema)
        seen.settle()
        keep = seen.counts > 1
        packed = np.stack([seen.keys[keep].view(np.int64), seen.counts[keep]], 1).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, t) for t in schema.types[:5]] + [pa.array([packed], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, cid bigint, cid2 bigint, par binary, frequent binary")


def _frequent_shingles(sets: DataFrame) -> np.ndarray:
    def unpack(batches):
        for batch in batches:
            for value in batch.column(0).to_pylist():
                pairs = np.frombuffer(value, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["h", "c"])

    counts = sets.where("frequent is not null").select("frequent").mapInArrow(unpack, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    rows = counts.where(F.col("c") > FREQUENT).orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(_U))


def most_differences(n: np.ndarray, low: np.ndarray, own: bool) -> np.ndarray:
    """Largest difference of a linked pair with a set of size n under the band [low, 2 low): n the smaller one, or the larger one from the band above."""
    other = 4 * n // 3 if own else np.minimum(2 * low - 1, n)
    return (n + other) // 7


class Signer:
    """Signatures of sets, given the sorted frequent shingles."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(frequent >> _U(44)).astype(np.int64)] = True

    def _rare(self, hashes: np.ndarray) -> np.ndarray:
        rare = ~self.seen[(hashes >> _U(44)).astype(np.int64)]
        check = np.flatnonzero(~rare)
        if len(check):
            at = np.minimum(np.searchsorted(self.frequent, hashes[check]), len(self.frequent) - 1)
            rare[check] = self.frequent[at] != hashes[check]
        return rare

    def sign(self, hashes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(signature, index of its set, role, slack code) over all roles and levels; role 0: under its own band, 1: under the band below."""
        sizes = np.diff(offs)
        rare, mixed = self._rare(hashes), mix(hashes + _U(0x9FB21C651E98DF25))
        band = np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)
        band -= (1 << band) > np.maximum(sizes, 1)
        out: list[list[np.ndarray]] = [[np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint8)]]
        for role, own in enumerate((True, False)):
            b = band if own else band - 1
            low = 1 << np.maximum(b, 0)
            picked = np.flatnonzero((sizes > 0) & (b >= 0) & (True if own else 3 * sizes <= 4 * (2 * low - 1)))
            sig, owner, slack = self._levels(picked, low, most_differences(sizes, low, own), hashes, rare, mixed, offs)
            code = np.where(slack < 0, 0, np.minimum(127, 1 + np.floor(8 * np.log2(np.maximum(slack, 0) + 1)))).astype(np.uint8)
            for x, more in zip(out, (sig, owner, np.full(len(sig), role, np.uint8), code[owner]), strict=True):
                x.append(more)
        return tuple(map(np.concatenate, out))

    def _levels(self, picked, low, most, hashes, rare, mixed, offs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signatures, their sets, and per set how many level-0 signatures it could do without; -1: it needs further levels."""
        out_sig, out_set, slack = [np.zeros(0, _U)], [np.zeros(0, np.int64)], np.full(len(most), -1, np.int64)
        for level in (0, 1, 2):
            if not len(picked):
                break
            sizes = offs[picked + 1] - offs[picked]
            ends = np.cumsum(sizes)
            at = np.repeat(offs[picked] - (ends - sizes), sizes) + np.arange(ends[-1])
            owner = np.repeat(picked, sizes)
            base = low[owner].astype(_U)
            tag = base * _U(4) + _U(level)
            if level == 2:
                out_sig.append(mix(mixed[at] + tag * _U(0x2545F4914F6CDD1D)))
                out_set.append(owner)
                break
            m = (low * 17 // 20 + 3 if level == 0 else low * 9 // 20 + 1).astype(_U)
            seg = ((hashes[at] >> _U(32)) * m[owner]) >> _U(32)
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
            first = np.flatnonzero(new)
            total = np.add.reduceat(mixed[at], first)
            count = np.diff(np.append(first, len(at)))
            place = (seg[first] * _U(0x9E3779B97F4A7C15)) ^ (tag[first] * _U(0xC2B2AE3D27D4EB4F))
            if level == 0:
                useful = np.add.reduceat(rare[at].astype(np.int64), first) > 0
                units = useful.astype(np.int64)
                out_sig.append(mix(total[useful] + place[useful]))
                out_set.append(owner[first][useful])
            else:
                units = np.minimum(count, 2)
                group = np.repeat(np.arange(len(first)), count)
                fewer = count[group] > 1
                out_sig += [mix(total + place), mix(total[group[fewer]] - mixed[at][fewer] + place[group[fewer]])]
                out_set += [owner[first], owner[fewer]]
            have = np.bincount(owner[first], units, minlength=len(most)).astype(np.int64)
            if level == 0:
                slack[picked] = np.maximum(have[picked] - most[picked] - 1, -1)
            picked = picked[have[picked] <= most[picked]]
        return np.concatenate(out_sig), np.concatenate(out_set), slack


def _signatures(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, records): per bucket and flush, packed records of 5 bytes of signature, 5 of class id, 1 of log size and role, 1 of slack."""
    schema = pa.schema([("bucket", pa.int64()), ("records", pa.binary())])

    def flush(parts: list[np.ndarray], nums: list[np.ndarray]):
        recs, bucket = np.concatenate(parts), np.concatenate(nums)
        order = np.argsort(bucket, kind="stable")
        recs, bucket = recs[order], bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(bucket))
        return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([recs[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], schema=schema)

    def run(batches):
        signer, parts, nums, rows, signed = Signer(frequent), [], [], 0, set()
        for part in sliced(batches, 0):
            hashes, offs = shingle_sets(part.column(0))
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(hashes), dtype=_U)])
            cid = mix(sums[offs[1:]] - sums[offs[:-1]])
            # A task signs copies once: their records would be equal, and all go to the same buckets.
            if len(signed) > MAX_SIGNED:
                signed.clear()
            new = np.zeros(len(cid), bool)
            for i, c in enumerate(cid.tolist()):
                if c not in signed:
                    signed.add(c)
                    new[i] = True
            sizes = np.diff(offs)
            hashes, cid, sizes = hashes[np.repeat(new, sizes)], cid[new], sizes[new]
            offs = np.concatenate([[0], np.cumsum(sizes)])
            sig, owner, role, slack = signer.sign(hashes, offs)
            rec = np.empty((len(sig), RECORD), np.uint8)
            rec[:, :5] = sig.view(np.uint8).reshape(-1, 8)[:, :5]
            rec[:, 5:10] = cid.view(np.uint8).reshape(-1, 8)[owner, 3:]
            rec[:, 10] = np.minimum(127, np.floor(np.log2(np.maximum(sizes, 1)) * SIZE_STEPS)).astype(np.uint8)[owner] | role << 7
            rec[:, 11] = slack
            parts.append(rec)
            nums.append(((sig >> _U(40)) % _U(buckets)).astype(np.int64))
            rows += len(sig)
            if rows > RECORDS_PER_FLUSH:
                yield flush(parts, nums)
                parts, nums, rows = [], [], 0
        if rows:
            yield flush(parts, nums)

    return docs.select("text").mapInArrow(run, "bucket bigint, records binary")


def _runs(blobs: pa.Table) -> pa.Table:
    """Of one bucket, by truncated class id: pairs (a, b, run 0), and members (a, its particulars as b, run > 0) of runs above SMALL_RUN.

    Particulars: log size, role << 7, slack code << 8, how many signatures have these very members << 15, number of members << 35.
    """
    raw = np.frombuffer(b"".join(blobs.column("records").to_pylist()), np.uint8).reshape(-1, RECORD)
    sig = np.zeros((len(raw), 8), np.uint8)
    sig[:, :5] = raw[:, :5]
    sig = sig.view(_U).ravel()
    order = np.argsort(sig)
    same = sig[order][1:] == sig[order][:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    sig, raw = sig[order], raw[order]
    cid = np.zeros((len(raw), 8), np.uint8)
    cid[:, :5] = raw[:, 5:10]
    cid, size, role, slack = cid.view(np.int64).ravel(), (raw[:, 10] & 127).astype(np.int64), (raw[:, 10] >> 7).astype(np.int64), raw[:, 11].astype(np.int64)
    order = np.lexsort((cid, size, sig))
    sig, cid, size, role, slack = sig[order], cid[order], size[order], role[order], slack[order]
    keep = np.append(True, (sig[1:] != sig[:-1]) | (cid[1:] != cid[:-1]))[:len(sig)]
    sig, cid, size, role, slack = sig[keep], cid[keep], size[keep], role[keep], slack[keep]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[:len(sig)])
    count = np.diff(np.append(first, len(sig)))
    a, b, r = [], [], []
    for k in np.unique(count[(count > 1) & (count <= SMALL_RUN)]).tolist():
        at = first[count == k]
        for i in range(k):
            for j in range(i + 1, k):
                ok = np.abs(size[at + j] - size[at + i]) <= SIZE_REACH
                a.append(cid[at + i][ok])
                b.append(cid[at + j][ok])
    r = [np.zeros(sum(map(len, a)), np.int64)]
    times: dict[int, int] = {}
    members = []
    for f, k in zip(first[count > SMALL_RUN].tolist(), count[count > SMALL_RUN].tolist(), strict=True):
        c, s = cid[f:f + k], size[f:f + k]
        name = int(mix(np.array([mix(c.view(_U) * _U(2) + role[f:f + k].astype(_U)).sum()], _U))[0] >> _U(2)) + 1
        times[name] = times.get(name, 0) + 1
        if times[name] > 1:
            continue
        members.append((name, c, s + (role[f:f + k] << 7) + (slack[f:f + k] << 8) + (k << 35)))
        i = 0
        while i < k:  # stretches of members that may be linked with their least one
            j = int(np.searchsorted(s, s[i] + SIZE_REACH, "right"))
            # Centres by the least of several hashes: runs with common members choose common centres.
            for centre in {i, *(i + int(mix(c[i:j].view(_U) ^ salt).argmin()) for salt in _SALTS)}:
                a.append(np.full(j - i, c[centre]))
                b.append(c[i:j])
                r.append(np.zeros(j - i, np.int64))
            i = j
    for name, c, rest in members:
        a.append(c)
        b.append(rest + (min(times[name], (1 << 20) - 1) << 15))
        r.append(np.full(len(c), name))
    cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    a, b, r = cat(a), cat(b), cat(r)
    pair = r == 0
    low, high = np.where(pair, np.minimum(a, b), a), np.where(pair, np.maximum(a, b), b)
    return pa.table({"a": low, "b": high, "run": r})


def _open_members(runs: DataFrame, scratch: list[str]) -> DataFrame:
    """(run, key): memberships of long runs that are left by the allocation.

    Signatures have one order for all sets: those in short runs first, then by the length of their run. If at most H of a set's
    segments are damaged in a partner, the first H + 1 of either's signatures have one in common (prefix filtering), so the rest
    of a set's memberships, its slack, can go: the longest runs, and for most sets all long ones.
    """
    m = runs.where("run > 0").selectExpr("run", "a AS key", "(b DIV 128) % 2 AS role", "(b DIV 256) % 128 AS code", "(b DIV 32768) % 1048576 AS times", "b DIV 34359738368 AS k")
    m = m.groupBy("key", "role", "run").agg(F.min("code").alias("code"), F.sum("times").alias("times"), F.max("k").alias("k"))
    each = Window.partitionBy("key", "role")
    m = m.withColumns({"before": F.sum("times").over(each.orderBy("k", "run")) - F.col("times"), "all": F.sum("times").over(each), "least": F.min("code").over(each)})
    left = m.where("before < all - CASE WHEN least = 0 THEN 0D ELSE floor(pow(2D, (least - 1) / 8D)) - 1 END").select("run", "key").distinct()
    left = written(left, scratch)
    # What is left of runs may be equal: they are named anew by their members.
    names = left.groupBy("run").agg(F.sum(F.xxhash64("key").cast("decimal(20,0)")).alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1")
    names = names.groupBy("total", "k").agg(F.min("run").alias("run")).select("run")
    return left.join(names, "run", "left_semi")


def _filtered(pairs: DataFrame) -> DataFrame:
    """Of (rep_a, n_a, par_a, rep_b, n_b, par_b): (rep_a, rep_b) of the pairs that sizes and parities don't rule out."""
    def run(batches):
        for batch in batches:
            c = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            most = (c["n_a"].to_numpy() + c["n_b"].to_numpy()) // 7
            ok = [_differences(x, y) <= m for x, y, m in zip(c["par_a"].to_pylist(), c["par_b"].to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c["rep_a"], c["rep_b"]], names=["rep_a", "rep_b"]).filter(pa.array(ok, pa.bool_()))

    sized = pairs.where("rep_a <> rep_b and 100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    found = sized.mapInArrow(run, "rep_a bigint, rep_b bigint")
    return found.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")).distinct()


def _verified(docs: DataFrame, pairs: DataFrame, scratch: list[str]) -> DataFrame:
    """The pairs (rep_a, rep_b) whose texts have 100 x intersection >= 75 x union, on their words."""
    ids = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("id")).distinct()
    bits = max(16, (8 * ids.count()).bit_length())
    named = docs.where("doc_id is not null")
    if bits > BITMAP_BITS:
        texts = named.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    else:  # the ids fit a bitmap of at most 2^BITMAP_BITS bits, which spares the other texts the shuffle
        slots = ids.select(F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("slot"))
        words = slots.selectExpr("slot DIV 64 AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
        bitmap = np.zeros(1 << (bits - 6), np.int64)
        bitmap[words.column(0).to_numpy()] = words.column(1).to_numpy()

        def wanted(batches):
            for batch in batches:
                at = batch.column(2).to_numpy()
                hit = (bitmap.view(_U)[at >> 6] >> (at & 63).astype(_U)) & _U(1)
                yield batch.select([0, 1]).filter(pa.array(hit.astype(bool)))

        texts = named.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))).mapInArrow(wanted, "doc_id bigint, text string")
    texts = written(texts, scratch)
    # Rows with one id and several texts (an id isn't a key for certain): any pair of them may carry the link.
    one = texts.select(F.col("doc_id").alias("rep_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("rep_b"), F.col("text").alias("text_b"))

    def check(batches):
        sets = functools.lru_cache(maxsize=32)(exact_set)
        for part in sliced(batches, 2, 512):
            ok = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                s, t = sets(x), sets(y)
                both = len(s & t)
                ok.append(bool(s) and 100 * both >= 75 * (len(s) + len(t) - both))
            yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    joined = one.join(small(pairs), "rep_a").join(two, "rep_b").select("rep_a", "rep_b", "text_a", "text_b")
    return joined.mapInArrow(check, "rep_a bigint, rep_b bigint").distinct()


def _spanning(links: DataFrame) -> DataFrame:
    """Links with the same components, fewer where stars overlap: each task keeps a forest of its share, by one end and by the other.

    Any share will do, so large shares are split (rebalanced) and a forest that has grown to MAX_FOREST nodes is begun afresh.
    """
    def forest(batches):
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up] = parent.setdefault(up, up)
                x = parent[x]
            return x

        for batch in batches:
            ok = []
            if len(parent) > MAX_FOREST:
                parent.clear()
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = find(a), find(b)
                ok.append(x != y)
                parent[max(x, y)] = min(x, y)
            yield batch.filter(pa.array(ok, pa.bool_()))

    for end in ("rep_b", "rep_a"):
        links = links.select("rep_a", "rep_b").hint("rebalance", F.col(end)).mapInArrow(forest, "rep_a bigint, rep_b bigint")
    return links


def _meet(group: pa.Table) -> pa.Table:
    """Pairs of members at home in a block with guests, of different components, that sizes and parities don't rule out."""
    group = group.sort_by("n")
    n, rep, comp, guest, main = (group.column(c).to_numpy() for c in ("n", "rep", "comp", "guest", "main"))
    par = group.column("par").to_pylist()
    width = np.array([len(x) // 8 for x in par])
    # Per width: the members at home by size, and their parities; those twice as wide folded too.
    homes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for w in np.unique(width[~guest]).tolist():
        at = np.flatnonzero(~guest & (width == w))
        homes[w] = at, np.frombuffer(b"".join(map(par.__getitem__, at.tolist())), _U).reshape(len(at), w)
    folded = {w // 2: (at, m[:, :w // 2] ^ m[:, w // 2:]) for w, (at, m) in homes.items() if w > 1}
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(guest).tolist():
        own, w = np.frombuffer(par[i], _U), int(width[i])
        for at, m, mine in ((*homes.get(w, (None, None)), own), (*folded.get(w, (None, None)), own), (*homes.get(w // 2, (None, None)), own[:w // 2] ^ own[w // 2:] if w > 1 else own)):
            if at is None:
                continue
            lo, hi = np.searchsorted(n[at], [-(-75 * n[i] // 100), 100 * n[i] // 75 + 1]).tolist()
            # Of two that aren't in the main component the smaller id is the guest.
            j = at[lo:hi]
            pick = np.flatnonzero((comp[j] != comp[i]) & (main[j] | (rep[i] < rep[j])))
            if len(pick):
                differ = np.bitwise_count(m[lo:hi][pick] ^ mine).sum(1, dtype=np.int64)
                good = rep[j[pick]][differ <= (n[i] + n[j[pick]]) // 7]
                a.append(np.minimum(rep[i], good))
                b.append(np.maximum(rep[i], good))
    return pa.table({"rep_a": np.concatenate(a), "rep_b": np.concatenate(b)})


def _across(members: DataFrame, parities: DataFrame, scratch: list[str]) -> DataFrame:
    """Members (run, rep, n, comp) of runs with several components: pairs of members of different components that the filter passes,
    among them every such pair of a run that may be linked.

    Runs are named by the least hash of their members, so the many runs of one family of near copies are one family, with each member
    once. Members are at home in a block of about BLOCK; those outside the family's largest component visit every block, in parties of
    about BLOCK. So the work is members times what the first search left outside, and no group exceeds two blocks by much.
    """
    mixed = members.groupBy("run").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.xxhash64("rep")).alias("family")).where("lo <> hi").select("run", "family")
    rows = written(members.join(mixed, "run").select("family", "rep", "n", "comp").distinct(), scratch)
    sizes = rows.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy("family").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("k"))
    parts = lambda k: F.ceil(k / BLOCK).cast("int")
    sizes = sizes.select("family", F.col("top.comp").alias("largest"), parts(F.col("k")).alias("blocks"), F.greatest(F.lit(1), parts(F.col("k") - F.col("top.k"))).alias("parties"))
    # Written before the join, which would else take the aggregate's dealing by family and put all rows of a large family into one task.
    sizes = small(written(few_files(sizes, rows.count()), scratch))
    rows = written(rows.join(sizes, "family").withColumn("main", F.col("comp") == F.col("largest")), scratch)
    rows = parities.join(small(rows), "rep")
    spread = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    # One expansion: (block, party, guest) for each place where the member is needed.
    home = F.transform(every(F.col("parties")), lambda p: F.struct(spread(F.col("blocks"), 0).alias("block"), p.alias("party"), F.lit(False).alias("guest")))
    away = F.transform(every(F.col("blocks")), lambda z: F.struct(z.alias("block"), spread(F.col("parties"), 1).alias("party"), F.lit(True).alias("guest")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("main"), home).otherwise(F.concat(home, away))))
    rows = rows.select("family", "at.block", "at.party", "at.guest", "rep", "n", "par", "comp", "main")
    return rows.groupBy("family", "block", "party").applyInArrow(_meet, "rep_a bigint, rep_b bigint").distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; see the module's description."""
    with batch_bytes(docs.sparkSession):
        return _components(docs, id_col, text_col)


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark, scratch = docs.sparkSession, []
    table_ = lambda df: written(df, scratch)
    slim = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    sets = table_(_sets(slim))
    frequent = _frequent_shingles(sets)
    sets = sets.where("frequent is null").drop("frequent")
    filled = sets.where("n > 0")
    # Equal sets have equal parities, so any row brings those of its class.
    classes = table_(filled.groupBy("cid", "cid2", "n").agg(F.min("doc_id").alias("rep"), F.first("par").alias("par")))
    keyed = classes.where("rep is not null").select(F.shiftrightunsigned("cid", 24).alias("key"), "rep", "n", "par")
    parities = keyed.select("rep", "par")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(16, total // SHINGLES_PER_BUCKET)
    runs = table_(_signatures(slim, frequent, buckets).groupBy("bucket").applyInArrow(_runs, "a bigint, b bigint, run bigint").distinct())
    side = lambda s: keyed.select(F.col("key").alias(s), F.col("rep").alias(f"rep_{s}"), F.col("n").alias(f"n_{s}"), F.col("par").alias(f"par_{s}"))
    pairs = runs.where("run = 0").select("a", "b").join(side("a"), "a").join(side("b"), "b")
    # Classes that share a truncated id meet too.
    twins = keyed.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    pairs, twins = _filtered(pairs), table_(twins.select("key"))
    if not twins.isEmpty():
        clashes = keyed.join(twins, "key").select(F.col("key").alias("run"), "rep", "n", F.col("rep").alias("comp"))
        pairs = pairs.unionByName(_across(clashes, parities, scratch)).distinct()
    pairs = table_(pairs)
    links = table_(_verified(slim, pairs, scratch))
    comp = connected_components(_spanning(links), "rep_a", "rep_b")
    members = _open_members(runs, scratch).join(keyed.select("key", "rep", "n"), "key").join(comp, F.col("rep") == F.col("node"), "left")
    members = members.select("run", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    rest = table_(_across(members, parities, scratch).join(pairs, ["rep_a", "rep_b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(_verified(slim, rest, scratch))
        comp = connected_components(_spanning(links), "rep_a", "rep_b")
    found = classes.join(comp, F.col("rep") == F.col("node"), "left").select("cid", "cid2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = filled.select("doc_id", "n", "cid", "cid2").join(found, ["cid", "cid2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = written(out.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))))
    dropped(spark, scratch)
    return out


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's. Rows with one id are one member of a group: of several, the one with the least
    text, then the least further columns in their order, stays, whatever the order of rows. Rows with a null id stay."""
    spark = docs.sparkSession
    keep, first = fresh(docs, "keep", "first")
    with batch_bytes(spark):
        ids = components(docs, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count(F.lit(1)).alias("k"))
        # What needs attention: ids that go (0), and ids that stay with one of several rows (their number).
        odd = written(ids.where("doc_id <> c OR k > 1").select(F.col("doc_id").alias(keep), F.when(F.col("doc_id") == F.col("c"), F.col("k")).otherwise(0).alias(first)))
    at = col(id_col).cast("bigint") == F.col(keep)
    single = docs.join(small(odd), at, "left_anti")  # rows with a null id stay too
    several = docs.join(small(odd.where(F.col(first) > 1)), at).select(*[col(c) for c in docs.columns])
    order = [c for c in (text_col, *docs.columns) if c != id_col and not isinstance(docs.schema[c].dataType, (MapType, VariantType))]
    least = several.groupBy(col(id_col)).agg(F.min_by(F.struct(*[col(c) for c in docs.columns]), F.struct(*[col(c) for c in dict.fromkeys(order)])).alias(first)).select(f"{first}.*")
    return single.unionByName(least)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
