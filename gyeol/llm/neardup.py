"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct shingles of SHINGLE words (four; the pipeline takes five), hashed by one function; its sketch is the SKETCH smallest hashes. Documents of equal sets form a
class, which one representative stands for. The values that sketches retain make inverted lists. Only the rarest values of a sketch are listed, so many that two sketches that share
LEAST_SHARED values share one of these (a common passage of unlike documents is not among them); two sets of likeness 0.8 share fewer with a probability below 1e-5, and small sets never.

Each list's members meet its pivot, the member whose values are in the most sets (the centre of a group of edited copies). Pairs whose union sketches
estimate a likeness far below 0.8 go; full sets decide over the rest, and the links' components come from large-star and small-star rounds. Pivots miss links. So members of lists that
are in several components after that meet again, exactly: by the rarest values of their whole sets, at places from which on enough values are left (across()). No list, link or component is collected.

Defined cases: fewer words than a shingle has are one shingle; null and empty texts have no set, are linked with nothing and are kept; equal sets are linked whatever their
texts; rows of one doc_id that differ are treated each on its own, and of those of one group one text is kept; a null doc_id is linked by its set like any other, and its component is the smallest id
of it that is not null (null if there is none; then one text of it is kept);
other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyeol.llm.common import durable, in_batches

SHINGLE = 4
SKETCH = 32
#: Of SKETCH values of a union, those that both sets have: at likeness 0.8 fewer with probability below 1e-5.
LEAST_SHARED = 14
#: Ids or keys that may be sent to every executor; beyond it, both sides are shuffled.
BROADCAST_IDS, BROADCAST_KEYS = 1_000_000, 500_000
PERCENT = 80
#: Sizes of sets are dealt into classes of this ratio, so that members of a list meet only those of a fitting size.
SIZES = 1.02


class Shingles:
    """The sorted distinct shingle hashes (63 bits) of texts."""

    def __init__(self, size: int = SHINGLE) -> None:
        self.size, self.seen = size, {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode(errors="surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.int64)
        if len(self.seen) > 150_000:
            self.seen.clear()
        seen, out = self.seen, []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh64_intdigest(w)
            out.append(h)
        w = np.array(out, dtype=np.uint64)
        n = min(self.size, len(w))
        h = np.full(len(w) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return np.unique((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)).astype(np.int64)


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n (size of the set), d1, d2 (digest of the set), sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(shingle)
        for b in batches:
            n, d1, d2, low = [], [], [], []
            for t in b["text"].to_pylist():
                s = sh.of(t)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                low.append(s[:SKETCH])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "n", "d1", "d2", "sketch"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(rows, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def prefixes(values: DataFrame, size: Column, least: Column) -> DataFrame:
    """rep, n, weight, key, pos, members: of each set the values that come first when all values are ordered by how many sets hold them, rarest first.

    values: rep, n, key. A set of size values that shares least of them with another has a value in common with it among its first size - least + 1, and so has the other; the
    rarest common value is among them. Values of one set alone come first of all; they are counted and not shuffled. pos is a value's place, from 0; members the sets
    that hold it; weight, the sum of members over all shared values of the set, is large at the centre of a group.
    """
    counts = durable(values.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    few = counts.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    shared = values.join(F.broadcast(counts) if few else counts, "key")
    sets = shared.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("members", "key"))).alias("r"))
    sets = sets.withColumn("own", (size - F.size("r")).cast("int")).withColumn("first", F.greatest(size - least + 1 - F.col("own"), F.lit(0)).cast("int"))
    sets = sets.withColumn("weight", F.aggregate("r", F.lit(0).cast("long"), lambda t, x: t + x["members"]))
    return sets.select("rep", "n", "weight", "own", F.posexplode(F.slice("r", F.lit(1), F.col("first")))).select("rep", "n", "weight", F.col("col.key").alias("key"), (F.col("own") + F.col("pos")).alias("pos"), F.col("col.members").alias("members"))


def listed(reps: DataFrame) -> DataFrame:
    """rep, n, weight, key, pos, members: the inverted lists of sketch values that two sets of likeness 0.8 meet in. reps: rep, n, sketch."""
    size = F.least("n", F.lit(SKETCH))
    # a whole set shares 80 per cent; from 0.8 * SKETCH values on it may meet a larger one, of which LEAST_SHARED are shared
    least = F.when(F.col("n") * 100 >= SKETCH * PERCENT, F.lit(LEAST_SHARED)).otherwise(F.ceil(F.col("n") * PERCENT / 100))
    return prefixes(reps.select("rep", "n", F.explode("sketch").alias("key")), size, least)


def with_pivots(lists: DataFrame) -> DataFrame:
    """a < b: the members of each list with its pivot, the one with the greatest weight. No more pairs than members; a pivot is an aggregate, so a long list is never in one place."""
    pivots = lists.groupBy("key").agg(F.max(F.struct("weight", F.negate("rep").alias("neg"), F.col("n").alias("size"))).alias("p"))
    met = lists.join(pivots, "key").select("rep", "n", F.negate("p.neg").alias("pivot"), "p.size").where(f"rep <> pivot AND 100 * least(n, size) >= {PERCENT} * greatest(n, size)")
    return met.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def in_several(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """lists with comp, the component of rep so far, and main, the one that most members of the key are in; only keys whose members are in several components."""
    rows = lists.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    by = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = by.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("key", F.col("top.comp").alias("main"))
    return rows.join(mixed, "key")


def across(hot: DataFrame, comp: DataFrame, docs: DataFrame, shingle: int = SHINGLE, again: bool = False) -> DataFrame:
    """a < b: pairs of members of hot that are in different components so far, and that their whole sets do not rule out. again: a doc_id may have several rows, all of one set.

    Two sets meet at their rarest common value. From there on each has only so many values left, and they share no more than the smaller rest: a member that has lost much of its
    group's text meets nothing of its own size. Members outside a list's main component look up the others, by classes of the sizes that such a rest allows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(shingle)
        for b in batches:
            sets = [sh.of(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["rep", "n", "w"])

    few = chosen(docs.select(F.col("doc_id").cast("long"), "text"), hot.select(F.col("rep").alias("doc_id")), "left_semi")
    sets = durable(in_batches(few.dropDuplicates(["doc_id"]) if again else few).mapInArrow(rows, "rep long, n long, w array<long>"))
    lists = prefixes(sets.select("rep", "n", F.explode("w").alias("key")), F.col("n"), F.ceil(F.col("n") * PERCENT / 100))
    held = durable(in_several(durable(lists), comp))
    of = lambda c: F.floor(F.log(c) / F.log(F.lit(SIZES)))
    most = F.floor(((100 + PERCENT) * (F.col("n") - F.col("pos")) - PERCENT * F.col("n")) / PERCENT)
    least = F.ceil(F.col("n") * PERCENT / 100)
    out = held.where("comp <> main").withColumn("most", most).withColumn("least", least).where("most >= least").withColumn("size", F.explode(F.sequence(of(F.col("least")), of(F.col("most")))))
    met = out.alias("x").join(
        held.withColumn("size", of(F.col("n"))).alias("y"),
        F.expr(f"""x.key = y.key AND x.size = y.size AND x.comp <> y.comp AND y.n BETWEEN x.least AND x.most
            AND {100 + PERCENT} * (y.n - y.pos) >= {PERCENT} * (x.n + y.n) AND 100 * x.n >= {PERCENT} * y.n"""),
    )
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def estimated(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs that their union sketch does not rule out."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    few = durable(chosen(reps, need, "left_semi", "rep"))
    side = lambda x: few.select(F.col("rep").alias(x), F.col("sketch").alias(f"s_{x}"))
    df = pairs.join(side("a"), "a").join(side("b"), "b")
    df = df.withColumn("u", F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, SKETCH))
    shared = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), "u"))
    return df.where(shared * SKETCH >= LEAST_SHARED * F.size("u")).select("a", "b")


def chosen(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """docs whose key is in ids (left_semi) or is not (left_anti); ids are sent around only if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, key, how)


def verified(pairs: DataFrame, docs: DataFrame, shingle: int = SHINGLE, again: bool = False) -> DataFrame:
    """The pairs whose full sets have a likeness of PERCENT / 100 at least. again: a doc_id may have several rows, all of one set."""
    need = durable(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(shingle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([sh.of(t).tobytes() for t in b["text"].to_pylist()], pa.binary())], ["doc_id", "full"])

    few = chosen(docs.select(F.col("doc_id").cast("long"), "text"), need, "left_semi")
    sets = in_batches(few.dropDuplicates(["doc_id"]) if again else few).mapInArrow(full, "doc_id long, full binary")
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("full").alias(f"full_{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b["full_a"], b["full_b"], strict=True):
                s, t = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return in_batches(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "full_a", "full_b")).mapInArrow(check, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component: the smallest id reachable, of every id in links (a < b). Alternates large-star and small-star."""
    edges = durable(links.select(F.col("b").alias("u"), F.col("a").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = durable(small)
        same = edges.exceptAll(new).isEmpty() and new.exceptAll(edges).isEmpty()
        edges = new
        if same:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def components_of_sets(sk: DataFrame, docs: DataFrame, shingle: int, again: bool = False) -> DataFrame:
    """n, d1, d2, component_id of every set in sk, the sketches of docs, where a doc_id has one set. again: a doc_id may have several rows."""
    classes = durable(sk.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = sk.join(classes.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"]).where(F.col("doc_id") == F.col("rep")).select("rep", "n", "sketch").dropDuplicates(["rep", "n"])
    reps = durable(reps)
    lists = durable(listed(reps))
    comp = components(verified(durable(estimated(durable(with_pivots(lists)), reps)), docs, shingle, again))
    hot = durable(in_several(lists, comp).select("rep").distinct())
    if not hot.isEmpty():
        more = durable(verified(durable(across(hot, comp, docs, shingle, again)), docs, shingle, again))
        if not more.isEmpty():
            comp = components(more.unionByName(comp.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))))
    return classes.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component_id"))


def text_key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")))


def by_texts(docs: DataFrame, shingle: int) -> tuple[DataFrame, int]:
    """doc_id, key, n_shingles, component_id, kept, for ids that are null or repeated: rows are told apart by doc_id and key, a hash of the text; and the hash's seed.

    The first row of a group, by id (null last) and key, stands for it."""
    seed = 0
    while True:
        keyed = docs.select(text_key(seed).alias("doc_id"), "text")
        sk = durable(sketches(keyed, shingle))
        sets = durable(sk.groupBy("doc_id").agg(F.min("n").alias("n"), F.min("d1").alias("d1"), F.min("d2").alias("d2"), F.max("d1").alias("e1"), F.max("d2").alias("e2")))
        if sets.where("d1 <> e1 OR d2 <> e2").isEmpty():
            break
        seed += 1  # two sets have one key
    named = components_of_sets(sk, keyed, shingle, again=True)
    sets = sets.join(named, ["n", "d1", "d2"], "left").select(F.col("doc_id").alias("key"), "n", F.col("component_id").alias("group"))
    rows = docs.select(F.col("doc_id").cast("long"), text_key(seed).alias("key")).join(sets, "key")
    first = rows.where("n > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first"))
    out = rows.join(first, "group", "left")
    stands = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id"), (stands | F.col("first").isNull()).alias("kept")), seed


def ids_tell(sk: DataFrame) -> bool:
    """Whether every row has an id of its own."""
    return sk.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty()


def by_ids(sk: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, where every row has an id of its own."""
    named = components_of_sets(sk, docs, shingle)
    # the copies of one set may be a third of all rows: their class is joined by a key that the copies share, which Spark splits where it is hot
    out = sk.select("doc_id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sk = durable(sketches(docs, shingle))
    return by_ids(sk, docs, shingle) if ids_tell(sk) else by_texts(docs, shingle)[0].drop("key")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs without those that another document of their group stands for; of rows with one doc_id and one text one stays, but rows with neither an id nor a word all stay."""
    sk = durable(sketches(docs, shingle))
    if ids_tell(sk):
        got = durable(by_ids(sk, docs, shingle))
        return chosen(docs, got.where("NOT kept").select("doc_id"), "left_anti")
    got, seed = by_texts(docs, shingle)
    gone = durable(got.where("NOT kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone")).distinct())
    rows = docs.withColumn("__key", text_key(seed))
    rows = rows.join(gone, (F.col("__key") == F.col("__gone")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_anti")
    bare = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return rows.where(~bare).dropDuplicates(["doc_id", "__key"]).unionByName(rows.where(bare)).drop("__key")
