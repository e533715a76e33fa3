"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes the set of its word shingles (64-bit hashes).  Texts with
   the same set form a class; its smallest doc_id stands for it.
2. The k smallest hashes of a set are its sketch.  Inverted lists of the
   retained values give the candidates.  Two sets at the threshold share at
   least h sketch values (by counting for sets within the sketch, else with a
   probability of 1 - 1e-9), so only the k - h + 1 rarest values of a sketch are
   listed: values that a third of all documents hold are listed by few of them.
   Rarity is read from counts of 2^20 buckets of values, so a task picks the
   rarest by itself and only what is listed travels.
3. Long lists are not expanded into pairs.  Each list first compares all its members
   with one of them.  Members that this joins to one component need no further
   test.  In a list of up to 16 members, which mostly met by accident, the other
   pairs are formed at once, where sizes and bits allow them, and wait for the
   components; so what travels for it are a few ids, and no bit strings a list.
   Longer lists in which many others are left are built anew over the full sets
   of their members: two sets at the threshold share one of the rarest fifth of
   their values, which documents that only have a passage in common do not.
   Then the members outside the main component of a list are taken as pivots,
   64, 512, ... per list and round, and compared with the members of other
   components, until none is left.  Near documents share most of their lists, and
   a pair of them is formed in the first one only.  No link between different
   components is lost, and a group of n copies costs about n comparisons.
4. A pair must pass set sizes and two bit strings.  Of one bit of the least hash
   in each of 128 bins, a tenth differ at the threshold and half between unrelated
   sets.  Of the parities of 512 further bins, no more can differ than the sets
   have values in which they differ.  Pairs are then filtered by the sketch of the
   union and confirmed on full sets; components of the confirmed links are returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palaver.llm.hashing import Words, long_lists, ranges, shingle_sets, utf8
from palaver.llm.shared import BROADCAST_IDS, components, only, stored
from palaver.plans.scale import checked_broadcast

K = 64  # values kept of a set
BITS, PARITIES = 128, 512
SIGNS = [f"b{i}" for i in range((BITS + PARITIES) // 64)]  # the bit strings, as numbers
ODD = SIGNS[BITS // 64 :]  # those of the parities
MISS = 1e-9  # probability that a link at the threshold shares fewer sketch values than asked for
PIVOTS = 64  # members of a list that its others are compared with in the first of these rounds
SHORT = 16  # members of a list up to which its pairs are listed, by sizes, instead of its members meeting pivots
FIRST = 16  # least lists of a member that tell whether a pair has met in an earlier list
CROWDED = 64  # members outside the main component above which a list is built anew from full sets
PERCENT = 80
BUCKETS = 1 << 20  # of values, in which their rarity is counted

C, L = F.col, F.lit


def _bits(items: np.ndarray) -> np.ndarray:
    """One bit of the least value in each of BITS bins, and the parity of the number of values in each of PARITIES others."""
    found = np.zeros(BITS, bool)
    found[(items & (BITS - 1))[::-1]] = ((items >> 7) & 1)[::-1] == 1  # the first of equal places is written last
    odd = np.bincount((items >> 20) & (PARITIES - 1), minlength=PARITIES) % 2 == 1
    return np.packbits(np.concatenate([found, odd])).view("<i8")


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in ranges(offsets):
                sets = list(shingle_sets(*words.of(data, offsets[a : b + 1]), size))
                bits = np.stack([_bits(s) for s in sets])
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.binary()), long_lists([s[:K] for s in sets]), *map(pa.array, bits.T)],
                    ["doc_id", "n", "key", "sketch", *SIGNS],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in ranges(offsets):
                sets = [s.tobytes() for s in shingle_sets(*words.of(data, offsets[a : b + 1]), size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "items"])

    return run


def _members(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in ranges(offsets):
                sets = list(shingle_sets(*words.of(data, offsets[a : b + 1]), size))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), long_lists(sets)], ["doc_id", "items"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, good = batch.column("items_a"), batch.column("items_b"), []
            for i in range(len(batch)):
                x, y = (np.frombuffer(col[i].as_buffer(), dtype=np.int64) for col in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def shared_values(n: int, percent: int) -> int:
    """How many of the K smallest values of a union both of its sets have, but for a probability of MISS.

    The larger set has n values, so the union has 100 n / percent at most; its K
    smallest are a sample without replacement.
    """
    total = max(K, 100 * n // percent)
    good = -(-percent * total // 100)

    def log_choose(x: int, y: int) -> float:
        return math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)

    below = 0.0
    for x in range(max(0, K - (total - good)), K + 1):
        below += math.exp(log_choose(good, x) + log_choose(total - good, K - x) - log_choose(total, K))
        if below > MISS:
            return x
    return K


def _need(n: Column, percent: int) -> Column:
    """Sketch values that a set of n values shares with every set it is linked with, at least."""
    sizes = [int(K * 1.25**i) for i in range(1, 24)] + [1 << 40]
    found = F.lit(shared_values(sizes[-1], percent))
    for size in reversed(sizes):
        found = F.when(n <= size, shared_values(size, percent)).otherwise(found)
    # a set within the sketch: its common values, less those the other's sketch may lack
    inside = F.greatest(F.lit(1), F.ceil(n * percent / 100) - F.greatest(F.lit(0), F.ceil(n * 100 / percent) - K))
    return F.when(n <= K, inside).otherwise(found).cast("int")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def _pairs_by_sketch(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose parities and sketches allow the threshold; only those of documents in a pair are moved."""
    reps = only(reps.select("doc_id", "sketch", "n", *ODD), stored(_ends(pairs), "ends"), "doc_id")
    left = reps.select(*[C(c).alias(f"{c}_a") for c in reps.columns]).withColumnRenamed("doc_id_a", "a")
    right = reps.select(*[C(c).alias(f"{c}_b") for c in reps.columns]).withColumnRenamed("doc_id_b", "b")
    odd = [F.bit_count(C(f"{c}_a").bitwiseXOR(C(f"{c}_b"))) for c in ODD]
    fits = (100 + percent) * sum(odd[1:], odd[0]) <= (100 - percent) * (C("n_a") + C("n_b"))
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    common = F.size(F.array_intersect(F.array_intersect(F.slice(union, 1, K), "sketch_a"), "sketch_b"))
    whole = (C("n_a") <= K) & (C("n_b") <= K)
    exact = 100 * F.size(F.array_intersect("sketch_a", "sketch_b")) >= percent * F.size(union)
    by_sketch = F.when(whole, exact).otherwise(common >= shared_values(1 << 40, percent))
    return pairs.join(left, "a").join(right, "b").where(fits & by_sketch).select("a", "b")


def _pairs_by_bits(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose first bits allow the threshold."""
    signs = bits.columns[1:]
    for end in ("a", "b"):
        pairs = pairs.join(bits.select(C("doc_id").alias(end), *[C(c).alias(f"{c}_{end}") for c in signs]), end)
    differ = [F.bit_count(C(f"{c}_a").bitwiseXOR(C(f"{c}_b"))) for c in signs]
    return pairs.where(sum(differ[1:], differ[0]) <= differing_bits(percent)).select("a", "b")


def _short_pairs(lists: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs within lists of up to SHORT members, without their heads, whose sizes and first bits allow the threshold."""
    others = lists.where((C("doc_id") != C("head.doc_id")) & (C("m") > 2) & (C("m") <= SHORT))
    left = others.select("value", C("doc_id").alias("a"), C("n").alias("n_a"))
    right = others.select("value", C("doc_id").alias("b"), C("n").alias("n_b"))
    pairs = left.join(right, "value").where((C("a") < C("b")) & _sizes_fit(C("n_a"), C("n_b"), percent))
    return _pairs_by_bits(pairs.select("a", "b").distinct(), bits, percent)


def differing_bits(percent: int) -> int:
    """How many of the BITS of two sets at the threshold differ at most, but for a probability of MISS."""
    p, above = (100 - percent) / 200, 1.0
    for k in range(BITS + 1):
        above -= math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k)
        if above < MISS:
            return k
    return BITS


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _fits(percent: int, other: str) -> Column:
    """Set size, bits and parities of a list's member allow the threshold with another's, whose columns begin with ``other``."""
    sizes = _sizes_fit(C("n"), C(f"{other}n"), percent)
    differ = [F.bit_count(C(b).bitwiseXOR(C(other + b))) for b in SIGNS]
    first, odd = sum(differ[1 : BITS // 64], differ[0]), sum(differ[BITS // 64 + 1 :], differ[BITS // 64])
    return sizes & (first <= differing_bits(percent)) & ((100 + percent) * odd <= (100 - percent) * (C("n") + C(f"{other}n")))


def _rarity(values: DataFrame) -> np.ndarray:
    """Rows of each of BUCKETS buckets of values: however large the table is, the result is not."""
    bucket = C("value").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")
    table = values.groupBy(bucket).agg(F.count("*").cast("float").alias("c")).toArrow()
    found = np.zeros(BUCKETS, np.float32)
    found[table.column("bucket").to_numpy()] = table.column("c").to_numpy()
    return found


def _rarest(rarity: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("items")
            ends, values, need = items.offsets.to_numpy(), items.flatten().to_numpy(), batch.column("need").to_numpy()
            for a, b in ranges(ends):
                size, own = np.diff(ends[a : b + 1]), values[ends[a] - ends[0] : ends[b] - ends[0]]
                row = np.repeat(np.arange(a, b), size)
                order = np.lexsort((own, rarity[own & (BUCKETS - 1)], row))  # rows stay together
                place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
                take = order[place < np.repeat(size - need[a:b] + 1, size)]
                which = pa.array(row[take])
                yield pa.RecordBatch.from_arrays([pa.array(own[take]), batch.column("doc_id").take(which), batch.column("n").take(which)], ["value", "doc_id", "n"])

    return run


def _rarest_members(size: int, percent: int, rarity: np.ndarray):
    members, rarest = _members(size), _rarest(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in members(batches):
            n = np.diff(batch.column("items").offsets.to_numpy()).astype(np.int64)
            need = -(-n * percent // 100)
            yield from rarest([pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(need)], ["doc_id", "items", "n", "need"])])

    return run


def _lists(sets: DataFrame) -> DataFrame:
    """(value, doc_id, n): the lists of the rarest values of each document.

    ``sets`` has doc_id, n, items, and need: so many of the items are shared with
    every linked document.  Two linked documents meet in a list whatever the
    order of rarity is, as long as it is one for all; so it is taken from counts
    of buckets of values, and no value travels for it.
    """
    rarity = _rarity(sets.select(F.explode("items").alias("value")))
    return sets.select("doc_id", "n", "need", "items").mapInArrow(_rarest(rarity), "value long, doc_id long, n long")


def _full_lists(docs: DataFrame, reps: DataFrame, ids: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The lists over the full sets of some documents: exact, as linked sets share percent of the larger one."""
    texts = only(docs.select("doc_id", "text"), ids, "doc_id")
    rarity = _rarity(texts.mapInArrow(_members(shingle), "doc_id long, items array<long>").select(F.explode("items").alias("value")))
    # one function makes the sets and picks from them: two would keep twice the workers in an executor
    return texts.mapInArrow(_rarest_members(shingle, percent, rarity), "value long, doc_id long, n long")


def _relabelled(labels: DataFrame | None, good: DataFrame) -> DataFrame:
    """(doc_id, label): the components after some more links; only components that these touch are walked."""
    if labels is None:
        return stored(components(good).withColumnRenamed("node", "doc_id"), "labels")
    ends = good
    for end in ("a", "b"):
        of = labels.select(C("doc_id").alias(end), C("label").alias(f"l{end}"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce(f"l{end}", end)).select("a", "b")
    joined = stored(components(ends), "joined")
    moved = labels.join(joined.select(C("node").alias("label"), C("label").alias("new")), "label", "left")
    moved = moved.select("doc_id", F.coalesce("new", "label").alias("label"))
    fresh = joined.withColumnRenamed("node", "doc_id").join(labels, "doc_id", "left_anti")
    return stored(moved.unionByName(fresh), "labels")


def links(docs: DataFrame, reps: DataFrame, *, shingle: int = 5, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(a, b): confirmed links that span every component of the graph of all links, and (doc_id, label): its components.

    Lists carry no bit strings; the first bits join the pairs that sizes let
    pass, made one, and all bits the long lists that meet pivots.  What has met all members
    leaves its list, and a list whose members are one component is done.  The pairs of
    short lists wait until the heads have joined what they can.
    """
    sets_ = reps.select("doc_id", "n", C("sketch").alias("items"), _need(C("n"), percent).alias("need"))
    bits = reps.select("doc_id", *SIGNS)
    lists = stored(_lists(sets_), "lists")
    heads = lists.groupBy("value").agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "n")).alias("head")).where("m > 1")
    lists = stored(lists.join(heads, "value"), "headed")
    pairs = lists.where((C("doc_id") != C("head.doc_id")) & _sizes_fit(C("n"), C("head.n"), percent))
    first_bits = bits.select("doc_id", *SIGNS[: BITS // 64])
    pairs = stored(_pairs_by_bits(pairs.select(C("head.doc_id").alias("a"), C("doc_id").alias("b")).distinct(), first_bits, percent), "met")
    waiting = stored(_short_pairs(lists, first_bits, percent).join(pairs, ["a", "b"], "left_anti"), "waiting")
    # a head has met all others of its list
    lists = lists.where((C("doc_id") != C("head.doc_id")) & (C("m") > SHORT)).select("value", "doc_id", "n")
    sets = tested = found = labels = None
    pivots, anew = PIVOTS, False
    while True:
        tried = stored(_pairs_by_sketch(pairs, reps, percent), "pairs")
        if found is None or tried.limit(1).count():
            ids = stored(_ends(tried), "ids")
            wanted = ids if sets is None else stored(ids.join(sets, "doc_id", "left_anti"), "wanted")
            more = stored(only(docs.select("doc_id", "text"), wanted, "doc_id").mapInArrow(_sets(shingle), "doc_id long, items binary"), "sets")
            sets = more if sets is None else sets.unionByName(more)
            here = only(sets, ids, "doc_id")
            full = tried.join(here.select(C("doc_id").alias("a"), C("items").alias("items_a")), "a")
            full = full.join(here.select(C("doc_id").alias("b"), C("items").alias("items_b")), "b")
            good = stored(full.mapInArrow(_confirm(percent), "a long, b long"), "links")
            found = good if found is None else found.unionByName(good)
            tested = tried if tested is None else tested.unionByName(tried)
            labels = _relabelled(labels, good)
        if waiting is not None:  # once: the pairs of short lists that the heads have left apart
            pairs, waiting = stored(_apart(waiting, labels), "apart"), None
            continue
        now = _open_lists(lists, labels)
        if not anew:  # once: crowded lists give way to lists over full sets
            anew = True
            crowded = now.where(C("others") > CROWDED).select("value").distinct()
            members = stored(now.join(crowded, "value", "left_semi").select("doc_id").distinct(), "crowded")
            if members.limit(1).count():
                again = _full_lists(docs, reps, members, shingle, percent)
                # a hash names a list of full sets, so that it is not taken for the sketches' list of the same value
                again = _open_lists(again.withColumn("value", F.xxhash64("value")), labels)
                now = now.where(C("others") <= CROWDED).unionByName(again)
        rest = now.where("label <> main").select("value", "doc_id", "n", "label")
        # lists of one group choose the same pivots
        rank = F.row_number().over(W.partitionBy("value").orderBy(F.xxhash64("doc_id"), "doc_id"))
        chosen = stored(rest.withColumn("rank", rank).where(C("rank") <= pivots).drop("rank"), "pivots")
        if not chosen.limit(1).count():
            return found, labels
        # pivots meet all members, so they leave their lists, and lists without other members outside the main component close
        lists = now.where(C("others") > pivots).select("value", "doc_id", "n").join(chosen.select("value", "doc_id"), ["value", "doc_id"], "left_anti")
        meeting = now.select("value", "doc_id", "n", "label").join(chosen.select("value").distinct(), "value", "left_semi")
        pairs = stored(_met(meeting, chosen, bits, percent).select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")).distinct(), "met")
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        pivots *= 8


def _first_lists(members: DataFrame) -> DataFrame:
    """(doc_id, n, firsts): the FIRST least lists of each member; texts that share a doc_id are told apart by their sizes."""
    rank = F.row_number().over(W.partitionBy("doc_id", "n").orderBy("value"))
    return members.select("doc_id", "n", "value", rank.alias("rank")).where(C("rank") <= FIRST).groupBy("doc_id", "n").agg(F.collect_list("value").alias("firsts"))


def _met(members: DataFrame, pivots: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(p, doc_id): pivots and members of other components that share a list, where sizes, bits and parities allow a link.

    Near documents share most of their lists, but a pair is formed in the least
    one: a list passes it over when both have a smaller list in common among
    their first ones, where p is a pivot, too.
    """
    signs = bits.columns[1:]
    ends = [side.join(_first_lists(side).join(bits, "doc_id"), ["doc_id", "n"]) for side in (members, pivots)]
    p = ends[1].select("value", C("doc_id").alias("p"), C("label").alias("pl"), *[C(c).alias(f"p_{c}") for c in ("n", "firsts", *signs)])
    unmet = F.coalesce(F.array_min(F.array_intersect("firsts", "p_firsts")) >= C("value"), F.lit(True))
    return ends[0].join(p, "value").where((C("label") != C("pl")) & _fits(percent, "p_") & unmet).select("p", "doc_id")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        of = labels.select(C("doc_id").alias(end), C("label").alias(f"l{end}"))
        pairs = pairs.join(checked_broadcast(of, BROADCAST_IDS), end, "left")
    return pairs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists with members of several components, each member's component, the largest one, and how many are in the others."""
    now = lists.join(checked_broadcast(labels, BROADCAST_IDS), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    now = stored(now, "labelled")  # read twice
    groups = now.groupBy("value", "label").agg(F.count("*").alias("k"))
    main = groups.groupBy("value").agg(F.count("*").alias("groups"), F.sum("k").alias("total"), F.max(F.struct("k", "label")).alias("top")).where("groups > 1")
    main = main.select("value", C("top.label").alias("main"), (C("total") - C("top.k")).alias("others"))
    return stored(now.join(main, "value").select("value", "doc_id", "n", "label", "main", "others"), "open")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than white space, A-Z lower-cased.
    Documents are linked when their shingle sets have a Jaccard similarity of
    ``percent`` / 100 or more; component_id is the smallest doc_id reachable.

    Defined cases: null and empty texts and texts of white space have no
    shingles and link with nothing; a text shorter than a shingle is one
    shingle; a row with a null doc_id takes no part in linking, keeps a null
    component_id and is kept; rows that share a doc_id are one document with
    several texts; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(C("doc_id").cast("long").alias("doc_id"), C("text").cast("string").alias("text"))
    found = stored(docs.mapInArrow(_sketches(shingle), "doc_id long, n long, key binary, sketch array<long>, " + ", ".join(f"{b} long" for b in SIGNS)), "sketches")
    named = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    several = stored(named.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "several")
    # sketches move only where the copies are too many for a broadcast
    copies = stored(named.select("doc_id", "key").join(classes, "key").where("doc_id <> rep"), "copies")
    reps = named.join(checked_broadcast(copies.select("key", "doc_id"), BROADCAST_IDS), ["key", "doc_id"], "left_anti")
    # only rows that share a doc_id can stand for a class twice
    repeated = checked_broadcast(several, BROADCAST_IDS)
    once = reps.join(repeated, "doc_id", "left_anti").select("key", "doc_id", "n", "sketch", *SIGNS)
    more = reps.join(repeated, "doc_id", "left_semi").select(once.columns).dropDuplicates(["key", "doc_id"])
    reps = stored(once.unionByName(more).drop("key"), "reps")
    member = copies.select(C("rep").alias("a"), C("doc_id").alias("b"))
    near, labels = links(docs, reps, shingle=shingle, percent=percent)
    twice = member.join(several.withColumnRenamed("doc_id", "b"), "b", "left_semi").select("a", "b")
    if twice.limit(1).count():  # rows that share a doc_id join their classes
        labels = components(near.unionByName(twice)).withColumnRenamed("node", "doc_id")
    out = (
        found.select("doc_id", "n", "key")
        .join(classes, "key", "left")
        .withColumn("rep", F.when(C("n") > 0, F.coalesce("rep", "doc_id")).otherwise(C("doc_id")))
        .join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left")
        .withColumn("component_id", F.when(C("doc_id").isNotNull(), F.coalesce("label", "rep")))
    )
    return out.select("doc_id", C("n").alias("n_shingles"), "component_id", F.coalesce(C("doc_id") == C("component_id"), F.lit(True)).alias("kept"))
