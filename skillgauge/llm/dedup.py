"""Near-duplicates: one-permutation MinHash with optimal densification, bands, star-shaped candidates.

1. Every document becomes its set of hashed word shingles. Documents with equal
   sets (exact copies among them) form a class; only classes go on.
2. One hash of each shingle serves all places of the signature: the hash range is
   cut into `PLACES` bins, each holding its least hash. An empty bin borrows from
   another bin found by hashing its own number (optimal densification).
3. Bands of the signature are bucket keys. In each bucket one member is the centre
   and all others are paired with it, so a bucket of n members has n - 1 pairs.
4. Pairs are confirmed on full sets and joined to components.
5. A bucket whose members are not all in one component yet may hide a link between
   two others. Such buckets get further centres, first the member with the least of its
   own, then more and more others (GROWTH times as many each round), which
   meet members of other components only, until every pair of a bucket is compared,
   joined anyway, or proved too different: sets of which too much is in no other set
   of these buckets cannot be similar to any, and tasks compare the outlines of the
   others (counts of hashes in ranges, which bound what two sets share). Pairs that
   these leave are confirmed on full sets. So no link between two classes of a bucket
   is lost, pairs within a group of copies are not spelled out, and no set is sent to
   each of its buckets.

With 64 bands of 8 places, two sets of similarity 0.8 meet in no bucket with a
probability of about 1 in 100,000; above that it falls fast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, mixed, partition_map, possible, settled, slices, stored

BANDS = 64
ROWS = 8
PLACES = BANDS * ROWS
BITS = PLACES.bit_length() - 1  # PLACES is a power of two
# Least similarity, in hundredths: intersection * 100 >= PERCENT * union.
PERCENT = 80
SHINGLE = 4
# By how much the number of centres of a bucket grows from round to round.
GROWTH = 32
# Shingles of the members, or centres, of a bucket that meet in one place, more or less.
BLOCK = 1 << 20
MEMBER = ("class", "component", "size", "shared", "outline")

FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
SIGNED = "doc_id bigint, mark bigint, n_shingles bigint, class binary, buckets array<bigint>"


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; of a shorter text, one hash of all its words."""
    words = Words(texts, lower=True)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words.vocabulary), np.uint64, len(words.vocabulary))
    h = hashes[words.codes]
    with np.errstate(over="ignore"):
        n = max(0, len(h) - width + 1)
        windows = np.zeros(n, np.uint64)
        for i in range(width):
            windows = windows * np.uint64(0x100000001B3) + mixed(h[i : i + n] * FACTORS[i % len(FACTORS)] + np.uint64(i))
        windows = mixed(windows)
    out = []
    for start, count in zip(words.starts.tolist(), words.counts.tolist(), strict=True):
        if count >= width:
            out.append(np.unique(windows[start : start + count - width + 1]))
        elif count:
            out.append(np.array([xxhash.xxh64_intdigest(h[start : start + count].tobytes(), seed=count)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def detours(places: int = PLACES, tries: int = 64) -> np.ndarray:
    """For each attempt and bin the bin that an empty one asks: the same for every document."""
    bin_, attempt = np.arange(places, dtype=np.uint64), np.arange(1, tries + 1, dtype=np.uint64)
    return (mixed((attempt[:, None] << np.uint64(32)) + bin_) % np.uint64(places)).astype(np.int64)


DETOURS = detours()
BAND_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of `PLACES` values for each sorted, non-empty set: the least hash of each bin, empty bins filled by densification."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # Bins are the top bits, so the first hash of a bin in order is its least.
    bins = owner * PLACES + (flat >> np.uint64(64 - BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out = np.zeros(len(sets) * PLACES, np.uint64)
    full = np.zeros(len(sets) * PLACES, bool)
    out[bins[first]] = flat[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    for ask in DETOURS:
        at = empty - empty % PLACES + ask[empty % PLACES]
        found = full[at]
        out[empty[found]] = out[at[found]]
        empty = empty[~found]
        if not len(empty):
            break
    for at in empty.tolist():  # a set so small that all attempts failed: its next full bin
        row = at - at % PLACES
        there = np.flatnonzero(full[row : row + PLACES])
        out[at] = out[row + there[np.searchsorted(there, at - row) % len(there)]]
    return out.reshape(len(sets), PLACES)


def bucket_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys of all bands, a row for each set."""
    signs = signatures(sets).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(BAND_SEEDS, signs.shape[:2])
    with np.errstate(over="ignore"):
        for row in range(ROWS):
            keys = mixed(keys * FACTORS[2] + signs[:, :, row])
    return keys.view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Set size, class (a 128-bit hash of the set), bucket keys (none for empty sets) and mark (a hash of the text) of every document."""

    def run(batch):
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in slices(texts):
            sets = shingle_sets(texts[a:b], width)
            some = [s for s in sets if len(s)]
            keys = iter(bucket_keys(some).tolist() if some else [])
            yield {
                "doc_id": ids.slice(a, b - a),
                "mark": batch.column("mark").slice(a, b - a),
                "n_shingles": [len(s) for s in sets],
                "class": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "buckets": [next(keys) if len(s) else None for s in sets],
            }

    text = F.col("text").cast("string")
    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")), run, SIGNED)


def full_sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """class and set (bytes of sorted hashes) for the documents that stand for a class in `needed` (class, doc_id)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def digested(batch):
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            sets = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
            yield {"class": [xxhash.xxh3_128_digest(s) for s in sets], "set": pa.array(sets, pa.binary())}

    def run(batch):
        texts, wanted = batch.column("text").to_pylist(), batch.column("class").to_pylist()
        for a, b in slices(texts):
            sets = [s.tobytes() for s in shingle_sets(texts[a:b], width)]
            # An id that occurs with several texts stands for a class by one of them only.
            right = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s) == wanted[a + i]]
            yield {"class": [wanted[a + i] for i in right], "set": pa.array([sets[i] for i in right], pa.binary())}

    # The only row of an id that stands for a class has that class: neither its text nor its set is shuffled.
    sure, rest = settled(possible(texts, needed), needed.select("doc_id").distinct())
    single = arrow_map(sure.select("text"), digested, "class binary, set binary")
    named = rest.join(needed, "doc_id")
    several = arrow_map(named.select("class", "text"), run, "class binary, set binary").groupBy("class").agg(F.first("set").alias("set"))
    return single.unionByName(several)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes those whose full sets are similar enough."""

    def run(batch):
        left, right = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
        keep = []
        for x, y in zip(left, right, strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                keep.append(False)
                continue
            common = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * common >= percent * (len(s) + len(t) - common))
        mask = pa.array(keep, pa.bool_())
        yield {"a": batch.column("a").filter(mask), "b": batch.column("b").filter(mask)}

    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a")
    return arrow_map(both.select("a", "b", "set_a", "set_b"), run, "a binary, b binary")


def outline(s: np.ndarray) -> bytes:
    """How many hashes of a set lie in each of equal ranges, of which there are more than hashes, at most twice as many; two ranges a byte, 15 or more as 15."""
    bits = max(1, len(s).bit_length())
    n = np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 15).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def outlines(sets: DataFrame) -> DataFrame:
    """class and outline of each set: an eighth of the set's bytes at most."""

    def run(batch):
        yield {"class": batch.column("class"), "outline": pa.array([outline(np.frombuffer(s, np.uint64)) for s in batch.column("set").to_pylist()], pa.binary())}

    return arrow_map(sets.select("class", "set"), run, "class binary, outline binary")


def ranges(lines: list[bytes]) -> np.ndarray:
    """The counts of outlines of one length, a row for each."""
    packed = np.frombuffer(b"".join(lines), np.uint8).reshape(len(lines), -1)
    return np.stack([packed & 15, packed >> 4], axis=2).reshape(len(lines), -1)


def folded(counts: np.ndarray, n: int) -> np.ndarray:
    """Counts of `n` wider ranges."""
    return counts if counts.shape[1] == n else counts.reshape(len(counts), n, -1).sum(2, dtype=np.uint16)


class Centres:
    """Some outlines side by side, so that another one meets all of them at once."""

    def __init__(self, rows: list[dict]):
        self.components = np.array([r["component"] for r in rows], object)
        self.sizes, self.shared = (np.array([r[k] for r in rows], np.int64) for k in ("size", "shared"))
        self.classes = [r["class"] for r in rows]
        lengths = np.array([len(r["outline"]) for r in rows])
        self.groups = []
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            counts = ranges([rows[i]["outline"] for i in at.tolist()])
            self.groups.append((at, counts, (counts == 15).any(1)))

    def candidates(self, row: dict, percent: int) -> list[tuple[bytes, bytes]]:
        """Pairs of a set with all centres of other components to which it may be similar.

        Two sets have no more hashes of one range in common than the one with fewer there has, so what the outlines
        leave out is not similar; where a count may be more than 15, sizes alone decide.
        """
        total = self.sizes + row["size"]
        most = np.minimum(self.shared, row["shared"])
        able = (100 * most >= percent * (total - most)) & (self.components != row["component"])
        if not able.any():
            return []
        mine = ranges([row["outline"]])
        if not (mine == 15).any():
            for at, counts, full in self.groups:
                pick = able[at] & ~full
                if pick.any():
                    n = min(counts.shape[1], mine.shape[1])
                    common = np.minimum(folded(counts[pick], n), folded(mine, n)).sum(1, dtype=np.int64)
                    able[at[pick]] = 100 * common >= percent * (total[at[pick]] - common)
        return [(min(row["class"], self.classes[k]), max(row["class"], self.classes[k])) for k in np.flatnonzero(able).tolist()]


def candidates_within(centres: DataFrame, members: DataFrame, many: int, percent: int) -> DataFrame:
    """Pairs (a, b) of centres with members of other components of their buckets, without those whose outlines show that they are not similar.

    Members of a bucket are dealt to blocks, and its centres (`many` at most, more or less) to
    parts, by the number of their shingles; every block meets every part in one place, centres first, so a large
    bucket is many tasks' work and a task holds one part's outlines. Both inputs have
    bucket, n and total (members and shingles of the bucket), class, component, size, shared (at most so much
    is in any other set) and outline. So a set is not sent to each of its buckets.
    """
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    parts = F.ceil(F.col("total") * F.least(F.lit(1.0), F.lit(many) / F.col("n")) / BLOCK).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = lambda n: F.pmod(F.xxhash64("class", "bucket"), n.cast("bigint")).cast("int")
    left = centres.select("bucket", F.lit(0).alias("kind"), own(parts).alias("part"), upto(blocks).alias("block"), *MEMBER)
    right = members.select("bucket", F.lit(1).alias("kind"), upto(parts).alias("part"), own(blocks).alias("block"), *MEMBER)
    key = ("bucket", "block", "part")
    rows = left.select(*key, "kind", *MEMBER).union(right.select(*key, "kind", *MEMBER)).repartition(*key).sortWithinPartitions(*key, "kind")

    def run(batches):
        place, held, centres = None, [], None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                here = (row["bucket"], row["block"], row["part"])
                if here != place:
                    place, held, centres = here, [], None
                if row["kind"] == 0:
                    held.append(row)
                elif held:
                    centres = Centres(held) if centres is None else centres
                    found += centres.candidates(row, percent)
            yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return partition_map(rows, run, "a binary, b binary").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge (a, b): class, component (its least node).

    Labels fall to the least label among neighbours and then to their label's own
    label (pointer jumping), so rounds grow with the logarithm of a chain. Each
    round is written to the shared folder.
    """
    both = edges.union(edges.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("class")).agg(F.least(F.min("b"), F.col("class")).alias("component")), "labels")
    for _ in range(most_rounds):
        told = both.join(labels.select(F.col("class").alias("b"), "component"), "b").select(F.col("a").alias("class"), "component", F.lit(None).alias("was"))
        fallen = told.union(labels.select("class", "component", F.col("component").alias("was"))).groupBy("class").agg(
            F.min("component").alias("component"), F.max("was").alias("was")
        )
        jump = labels.select(F.col("class").alias("component"), F.col("component").alias("further"))
        new = fallen.join(jump, "component", "left").select("class", "was", F.least("component", F.coalesce("further", "component")).alias("component"))
        new = stored(new, "labels")
        labels = new.select("class", "component")
        if new.where("was != component").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def joined_components(found: DataFrame, fresh: DataFrame) -> DataFrame:
    """`found` after further edges: these join components (or single nodes), which are far fewer than nodes."""
    of = lambda node: found.select(F.col("class").alias(node), F.col("component").alias(f"c{node}"))
    raised = fresh.join(of("a"), "a", "left").join(of("b"), "b", "left")
    raised = raised.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    merged = components(stored(raised, "component-links")).select(F.col("class").alias("component"), F.col("component").alias("whole"))
    old = found.join(merged, "component", "left").select("class", F.coalesce("whole", "component").alias("component"))
    single = merged.join(found.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("class"), F.col("whole").alias("component"))
    return stored(old.union(single), "components")


def own_shingles(sets: DataFrame) -> DataFrame:
    """class, own: how many shingles of a set are in no other set of `sets`."""

    def spread(batch):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("set").to_pylist()]
        if sets:
            yield {"class": batch.column("class").take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))), "shingle": np.concatenate(sets)}

    each = arrow_map(sets.select("class", "set"), spread, "class binary, shingle bigint")
    # Frequent shingles shrink to a row per task before the shuffle.
    single = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    return single.groupBy("class").agg(F.count("*").alias("own"))


def shared_sizes(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """class, size of its set, and how much of it at most another of `members` can have."""
    own = own_shingles(sets.join(members, "class", "left_semi"))
    sized = members.join(classes.select("class", "size"), "class").join(own, "class", "left")
    return stored(sized.select("class", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")), "sizes")


def torn_buckets(labelled: DataFrame) -> DataFrame:
    """Buckets whose members are of more than one component."""
    return labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")


def joined_by_class(places: DataFrame, facts: DataFrame) -> DataFrame:
    """`places` (rows of classes in their buckets, `BANDS` at most for each) with the columns of `facts`: each class is joined once."""
    rest = [c for c in places.columns if c != "class"]
    held = places.groupBy("class").agg(F.collect_list(F.struct(*rest)).alias("_held"))
    return held.join(facts, "class").select("class", F.inline("_held"), *[c for c in facts.columns if c != "class"])


def with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))


def judged(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, component_id and class_size of every row; see `near_duplicates`."""
    table = stored(signed(docs, width), "signed")
    classes = stored(
        table.where("class IS NOT NULL").groupBy("class").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("class_size"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets")
        ),
        "classes",
    )
    # Counts and the join that follows read one exchange: few buckets have more than one member, so counting ahead of it would not shrink rows.
    members = classes.select("class", F.explode("buckets").alias("bucket")).repartition("bucket")
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("class").alias("centre")).where("n > 1")
    buckets = stored(members.join(crowded, "bucket"), "buckets")
    needed = buckets.select("class").distinct().join(classes, "class").select("class", F.col("least").alias("doc_id"))
    named = needed.where("doc_id IS NOT NULL")
    sets = stored(full_sets(docs, named, width), "sets")

    pairs = buckets.where("class != centre").select(F.col("centre").alias("a"), F.col("class").alias("b")).distinct()
    found = components(stored(similar(pairs, sets, percent), "links"))
    wide = buckets.where("n > 2").select("bucket", "class")
    wide = stored(wide.join(torn_buckets(with_components(wide, found)), "bucket"), "torn")
    if not wide.isEmpty():
        # Sets of which too much is in no other set here cannot be similar to any, and leave their buckets.
        sizes = shared_sizes(wide.select("class").distinct(), classes, sets)
        able = sizes.where(100 * F.col("shared") >= percent * F.col("size"))
        wide = joined_by_class(wide, able)
        counted = wide.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        placed = F.pmod(F.xxhash64("class", "bucket"), F.col("n")).alias("place")
        wide = stored(wide.join(counted.where("n > 1"), "bucket").select("bucket", "class", "size", "shared", "n", "total", placed), "able")
        sets = stored(sets.join(wide.select("class").distinct(), "class", "left_semi"), "able-sets")
        lines = stored(outlines(sets), "outlines")
    lowest = 0
    while not wide.isEmpty():
        labelled = with_components(wide.where(F.col("n") >= lowest), found)
        active = stored(labelled.join(torn_buckets(labelled), "bucket"), "active")
        if active.isEmpty():
            break
        if lowest:
            # Members stand in a fixed order; those of places [lowest, GROWTH * lowest) are this round's centres.
            centres = active.where((F.col("place") + 1 >= lowest) & (F.col("place") + 1 < GROWTH * lowest))
        else:
            # Before that, the member that has least of its own: most copies of one text are near it.
            own = F.struct(1 - F.col("shared") / F.col("size"), "class")
            centres = active.join(active.groupBy("bucket").agg(F.min_by("class", own).alias("class")), ["bucket", "class"], "left_semi")
        # Members of the component that all centres of their bucket are of have nothing to meet.
        reach = centres.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        others = active.join(reach, "bucket").where("component != low OR component != high").drop("low", "high")
        lined = lambda rows: joined_by_class(rows, lines)
        near = stored(candidates_within(lined(centres), lined(others), GROWTH * max(1, lowest), percent), "near")
        lowest = max(1, lowest * GROWTH)
        if near.isEmpty():
            continue
        # Few pairs are left, and each is confirmed on full sets once, not in each of its buckets.
        met = sets.join(near.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "class", "left_semi")
        fresh = stored(similar(near, met, percent), "links")
        if not fresh.isEmpty():
            found = joined_components(found, fresh)

    joined = with_components(classes, found)
    heads = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named_classes = joined.join(heads, "component").select("class", "component_id", "class_size")
    columns = ["doc_id", "mark", "n_shingles", "component_id", "class_size"]
    empty = table.where("class IS NULL").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("bigint").alias("class_size"))
    rest = table.where("class IS NOT NULL").select("doc_id", "mark", "n_shingles", "class").join(named_classes, "class").drop("class")
    return rest.select(*columns).unionByName(empty)


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept, class_size.

    Null and empty texts have empty sets, are linked with nothing and kept. Equal
    sets are one class whose size counts rows. A set that occurs with
    null ids only is linked with nothing, has a null component_id and is not kept. Rows with the same id and the same set are judged alike.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return judged(docs, width, percent).select("doc_id", "n_shingles", "component_id", kept, "class_size")


def distinct_documents(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """`docs`, with all their columns, with one row of each group of near-duplicates: that with the least id.

    Rows without an id are known by their text; of a group without ids, one row
    stays. Rows are judged by id and text: of rows with one id, those whose texts are near each
    other are one group, of which the text with the least hash stays, and texts unlike all others stay too. Of equal rows one stays.
    """
    uid, mark = "_dedup_uid", "_dedup_mark"
    text = F.col("text").cast("string")
    own = F.coalesce(F.col("doc_id").cast("bigint"), F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62))
    known = docs.withColumns({uid: own, mark: F.xxhash64(text)})
    rows = judged(known.select(F.col(uid).alias("doc_id"), "text"), width, percent).where("doc_id = component_id")
    # Empty sets are groups of their own, whatever their id.
    group = F.when(F.col("n_shingles") == 0, F.col("mark")).otherwise(F.lit(0))
    ids = rows.groupBy(F.col("doc_id").alias(uid), group.alias("group")).agg(F.min("mark").alias(mark)).select(uid, mark)
    return known.join(ids, [uid, mark], "left_semi").dropDuplicates([uid, mark]).select(*docs.columns)
