"""SimHash near-duplicates through a byte-position inverted index with count filtering."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.operators.components import connected_components
from attesta.plans.staging import Staging, bounded_batches

SEED = 42
_BLOCK = 1 << 16
#: Bits of a fingerprint's other half that may differ in a candidate, shingles of a short text, and rounds of stars.
OTHER, SHORT, STARS = 9, 40, 3
#: Texts of a posting list up to which each is looked at for another one near to it before it is a row.
NARROW = 16


def _shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, in blocks."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    line = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    for at in range(0, n, _BLOCK):
        spans = zip(starts[at : min(n, at + _BLOCK)].tolist(), ends[at + size - 1 : at + size - 1 + _BLOCK].tolist(), strict=False)
        yield np.array([digest(line[s:e], SEED) for s, e in spans], "<u8")


def _majority(blocks: Iterable[np.ndarray]) -> int:
    count, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        n += len(hashes)
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<i8")[0]) if n else 0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits as a signed integer: a bit is 1 if over half of the shingles' XXH64 values have it.

    A-Z are lower-cased, words are split at ASCII white space, shingles count as often as they occur.
    Fewer words than a shingle has: the whole sequence is the one shingle. No words or null: zero.
    """
    return _majority(_shingle_hashes(text, shingle))


def _majorities(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes the 64 bits that over half of them have, by adders over whole words."""
    n, planes, level = hashes.shape[1], [], [hashes]
    while level:
        carries, x = [], np.concatenate(level, axis=1) if len(level) > 1 else level[0]
        while x.shape[1] > 1:
            third = x.shape[1] // 3
            if third:
                u, v, w = x[:, :third], x[:, third : 2 * third], x[:, 2 * third : 3 * third]
                both = u ^ v
                carries.append(u & v | w & both)
                x = np.concatenate([both ^ w, x[:, 3 * third :]], axis=1)
            else:
                carries.append(x[:, :1] & x[:, 1:])
                x = x[:, :1] ^ x[:, 1:]
        planes.append(x[:, 0])
        level = carries
    bits = np.unpackbits(np.ascontiguousarray(np.stack(planes, 1)).view(np.uint8).reshape(len(hashes), len(planes), 8), axis=2, bitorder="little")
    count = np.tensordot(bits.astype(np.int64), 1 << np.arange(len(planes)), (1, 0))
    return np.packbits(2 * count > n, axis=1, bitorder="little").view("<i8")[:, 0]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Ascending distinct XXH64 values of a text's word shingles."""
    blocks = list(_shingle_hashes(text, shingle))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, "<u8")


def sketch(text: str | None, shingle: int, prints: int) -> list[int]:
    """``prints`` fingerprints of one text's distinct shingles over hashes that are unrelated; the first is over
    XXH64 itself, like ``fingerprint``. No words: zeros."""
    return _sketch(shingle_set(text, shingle), prints)


def _sketch(hashes: np.ndarray, prints: int) -> list[int]:
    if not len(hashes):
        return [0] * prints
    out: list[int] = []
    step = max(1, (1 << 18) // len(hashes))
    for at in range(0, prints, step):
        rows = []
        for k in range(at, min(prints, at + step)):
            rows.append(hashes)
            hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = hashes ^ (hashes >> np.uint64(32))
        out += _majorities(np.stack(rows)).tolist()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` (long) of each row; only these columns are read."""
    source = docs.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([fingerprint(t.as_py(), shingle) for t in b.column("t")], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], "fp"])

    schema = ", ".join([*(f"k{i} {docs.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "fp bigint"])
    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "fp")


def _index_positions(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every ``least`` equal positions out of eight hold one.

    Five equal bytes put three into one half of the eight, three put two there; so the triples (or pairs)
    within the halves are enough, and a posting list is keyed by their joint value.
    """
    size = 3 if least >= 5 else 2 if least >= 3 else 1
    halves = [range(4), range(4, 8)] if size > 1 else [range(8)]
    return [c for half in halves for c in combinations(half, size)]


def links(prints: DataFrame, radius: int = 3, fp: str = "fp", by: tuple[str, ...] = (), known: str | None = None) -> DataFrame:
    """``(a, b)``, a < b: every pair of different fingerprints of ``prints`` at most ``radius`` bits apart.

    ``radius`` differing bits leave at least ``8 - radius`` of the eight bytes equal. An inverted index
    maps the values at certain byte positions to fingerprints; for each pair that meets in a posting list
    the equal bytes are tallied, pairs below the guaranteed number fall out, the rest are verified by
    counting bits. A pair that meets in several lists counts in the first of them. Tally and bit count
    are conditions of the join, so pairs that fail are never rows, and a large list's join can be split.

    ``prints`` may repeat fingerprints and hold nulls; both have no effect. With columns ``by``, only fingerprints
    that agree in them are paired, and the result has them too. Pairs that agree in the column ``known``, as
    those linked before, are not made.
    """
    if not 0 <= radius <= 7:
        raise ValueError("radius must be 0 to 7: beyond that no byte need be equal")
    least = 8 - radius
    sets = _index_positions(least)
    masks = [sum(255 << 8 * p for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    lists = F.array(*[F.struct(F.lit(i).alias("list"), F.col(fp).bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)])
    held = [*by, *([known] if known else [])]
    posts = prints.select(*held, fp).where(F.col(fp).isNotNull()).distinct().select(*held, F.col(fp).alias("f"), F.inline(lists))
    one, two = posts.alias("one"), posts.alias("two")
    x = F.col("one.f").bitwiseXOR(F.col("two.f"))
    tally: Column = reduce(lambda p, q: p + q, [(x.bitwiseAND(F.lit((255 << 8 * p) - ((1 << 64) if p == 7 else 0))) == 0).cast("int") for p in range(8)])
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(signed)])
    on = (
        (F.col("one.list") == F.col("two.list"))
        & (F.col("one.bytes") == F.col("two.bytes"))
        & (F.col("one.f") < F.col("two.f"))
        & (tally >= least)
        & (F.bit_count(x) <= radius)
        & (first == F.col("one.list"))
    )
    on = reduce(lambda p, c: p & (F.col(f"one.{c}") == F.col(f"two.{c}")), by, on)
    if known:
        on &= F.col(f"one.{known}") != F.col(f"two.{known}")
    return one.join(two, on).select(*[F.col(f"one.{c}").alias(c) for c in by], F.col("one.f").alias("a"), F.col("two.f").alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` for each row of ``docs``.

    ``component_id`` is the smallest key that is reached over links between fingerprints, the row's own
    included. Equal fingerprints are one node, however many rows have them. Null texts have fingerprint
    zero; rows with a null key keep it and get the smallest key of their component (null if it has none);
    repeated keys keep one row each. An empty table gives an empty result. A very long text is hashed in blocks; other columns
    aren't read, whatever their names.
    """
    stage = Staging(docs.sparkSession, "simhash")
    each = stage.put(fingerprints(docs, shingle, text, (key,)), "each")
    nodes = stage.put(each.groupBy("fp").agg(F.min(key).alias("k")), "nodes")
    near = stage.put(links(nodes, radius), "near")
    known = nodes.select("fp", F.struct(F.col("k").isNull().alias("none"), "k", "fp").alias("node"))
    ends = near.join(known.withColumnsRenamed({"fp": "a", "node": "na"}), "a").join(known.withColumnsRenamed({"fp": "b", "node": "nb"}), "b")
    roots = connected_components(ends, "na", "nb")
    whole = known.join(roots, "node", "left").select("fp", F.coalesce("root.k", "node.k").alias("component_id"))
    return each.join(stage.put(whole, "whole"), "fp").select(key, "fp", "component_id")


def _most_apart(likeness: float, prints: int, deviations: float) -> float:
    """Bits of ``prints`` fingerprints that two sets of a likeness differ in, and so many standard deviations more.

    A bit differs with the chance of the angle between the sets' sums: acos(2 J / (1 + J)) of half a turn.
    """
    p, n = math.acos(2 * likeness / (1 + likeness)) / math.pi, 64 * prints
    return n * p + deviations * math.sqrt(n * p * (1 - p))


def _halves(x: Column) -> tuple[tuple[int, Column, Column], ...]:
    """Each half of 64 bits by its number, with the other one."""
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    return (0, low, high), (1, high, low)


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, shingle: int, least: float, stage: Staging, name: str) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose shingle sets have a Jaccard likeness of ``least`` or more.

    A wide limit on the share of differing bits over all fingerprints keeps far pairs from the exact comparison; it stands
    for a likeness less by 0.2, some nine standard deviations. The sets are made again for the texts that are left.
    """
    wide = math.acos(2 * (least - 0.2) / (0.8 + least)) / math.pi
    apart = F.aggregate(F.zip_with("fps", "fps2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.least("n", "n2") >= F.greatest("n", "n2") * (least - 1e-9)
    got = pairs.distinct().join(nodes.select(F.col("id").alias("a"), "fps", "n"), "a").join(nodes.select(F.col("id").alias("b"), F.col("fps").alias("fps2"), F.col("n").alias("n2")), "b")
    got = stage.put(got.where(sizes & (apart <= F.size("fps") * 64 * wide)).select("a", "b", "n", "n2"), f"{name}_near")
    ids = got.select(F.col("a").alias("id")).unionByName(got.select(F.col("b").alias("id"))).distinct()
    wanted = ids.join(nodes.select("id", "node"), "id").select("id", "node.k", "node.tag").alias("w")
    texts = source.alias("s").join(wanted, F.col("s.k").eqNullSafe(F.col("w.k")) & (F.col("s.tag") == F.col("w.tag"))).select("id", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingle_set(t.as_py(), shingle).view("<i8") for t in b.column("t")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("id"), sets], ["id", "s"])

    sets = stage.put(texts.mapInArrow(run, "id bigint, s array<bigint>").dropDuplicates(["id"]), f"{name}_sets")
    shared = F.size(F.array_intersect("s", "s2"))
    met = got.join(sets.withColumnRenamed("id", "a"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
    close = stage.put(met.where(shared >= (F.col("n") + F.col("n2") - shared) * F.lit(least) - 1e-9).select("a", "b"), f"{name}_close")
    stage.drop(f"{name}_near", f"{name}_sets")
    return close


def near_groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, prints: int = 36, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, tag, first`` for each row: whether it is the one of its group of near copies that stays.

    Texts are near copies if the Jaccard likeness of their distinct word shingles (64-bit hashes) is ``least`` or more,
    and so are those that a chain of such pairs joins. Every pair is verified on the shingles; equal sets are one node.
    Candidates come from ``prints`` unrelated fingerprints in a byte-position index: posting lists are keyed by three
    bytes of one half, and the other half may differ in ``OTHER`` bits. At a likeness of 0.8 a byte is equal with a chance of
    0.27, which makes a list common to a pair in 12 % of fingerprints and in 99 % of pairs with 36 of them. Sets of at most
    ``SHORT`` shingles also meet in the lists of their smallest shingles, of which two that are alike enough share one.
    Large groups come first: in ``STARS`` rounds each text is compared with hubs of its lists, the texts that meet most
    others. Then texts that a chain of verified pairs does not join yet are paired within their lists, if their fingerprints
    differ in no more bits than a likeness of ``least`` and four and a half standard deviations explain, or, where both are
    short, if their sets are alike enough. So a large group of copies makes about as many rows as it has texts. Repeated rows are one text, a very long text one set.

    The smallest (key, tag) of a group stays, a null key counting as smallest; ``tag`` is a hash of the text.
    Texts without words are one group. An empty table gives an empty result; other columns aren't read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    stage = Staging(docs.sparkSession, "groups")
    source = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("tag"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t in b.column("t"):
                h = shingle_set(t.as_py(), shingle)
                n = len(h)
                rows.append((xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63), n, _sketch(h, prints), h.view("<i8") if n <= SHORT else []))
            got = list(zip(*rows, strict=True)) if rows else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("tag"), *(pa.array(x, kind) for x, kind in zip(got, kinds, strict=True))], ["k", "tag", "id", "n", "fps", "few"])

    each = stage.put(source.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, tag bigint, id bigint, n int, fps array<bigint>, few array<bigint>"), "each")
    nodes = each.groupBy("id").agg(F.min(F.struct("k", "tag")).alias("node"), F.first("n").alias("n"), F.first("fps").alias("fps"), F.first("few").alias("few"))
    nodes = stage.put(nodes, "nodes")
    some = nodes.where("n > 0")

    near = lambda post, x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y) if isinstance(y, str) else y)) <= F.when(F.col(post) < 0, F.lit(OTHER + 4)).otherwise(F.lit(OTHER))

    # posting lists with more than one text; of a narrow one the texts that are near to another one there, as most that unrelated
    # texts share hold none and such lists grow with the square of the input. m: the others met
    triples = [sum(255 << 8 * p for p in c) for c in combinations(range(4), 3)]
    lists = F.array(*[F.struct((F.col("p").cast("long") * 8 + i + 4 * half).alias("list"), mine.bitwiseAND(F.lit(m)).alias("bytes"), other.alias("rest")) for half, mine, other in _halves(F.col("fp")) for i, m in enumerate(triples)])
    w = Window.partitionBy("post")
    mates = F.collect_list(F.when(F.col("m") <= NARROW, F.struct("id", "rest"))).over(w)
    near_mates = F.size(F.filter("mates", lambda y: (y["id"] != F.col("id")) & near("post", "rest", y["rest"])))
    others = F.when(F.col("m") > NARROW, F.col("m") - 1).otherwise(near_mates)
    shared_lists = lambda posts: posts.withColumn("m", F.count("*").over(w)).where("m > 1").withColumn("mates", mates).select("post", "id", "rest", others.cast("long").alias("m")).where("m > 0")
    parts = []
    for at in range(0, prints, 12):
        flat = some.select("id", F.posexplode(F.slice("fps", at + 1, 12)).alias("q", "fp")).withColumn("p", F.col("q") + at)
        posts = flat.select("id", F.inline(lists)).select(F.shiftleft("list", 32).bitwiseOR(F.col("bytes")).alias("post"), "id", "rest")
        parts.append(stage.put(shared_lists(posts), f"posts{at}"))
    rare = (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int")
    small = some.where(F.col("n") <= SHORT).select("id", F.explode(F.slice("few", F.lit(1), rare)).alias("s"), F.element_at("fps", 1).bitwiseAND(F.lit(0xFFFFFFFF)).alias("rest")).select(F.col("s").bitwiseOR(F.lit(-(1 << 63))).alias("post"), "id", "rest")
    parts.append(stage.put(shared_lists(small), "short"))
    # a row a text with its posts, so that what is known of a text is joined once and not once a post
    posted = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("m").alias("meets"), F.collect_list(F.struct("post", "rest")).alias("posts"))
    posted = stage.put(posted, "lists")
    # a list's hub is the text that meets most others over all lists: among copies of one text, the one nearest to all
    met = posted.select("id", "meets", F.inline("posts")).withColumn("hub", F.max(F.struct("meets", "id", "rest")).over(w)).drop("meets")
    # the hubs that a text can be compared with in all rounds: those that share most lists with it, and those that meet most others
    hubs = met.where((F.col("id") != F.col("hub.id")) & near("post", "rest", "hub.rest")).groupBy("id", F.col("hub.id").alias("h")).agg(F.count("*").alias("lists"), F.max("hub.meets").alias("meets"))
    best = lambda by: F.slice(F.sort_array(F.collect_list(F.struct(by, "h", "lists", "meets")), False), 1, STARS)
    plain = lambda x: F.struct(x["h"].alias("h"), x["lists"].alias("lists"), x["meets"].alias("meets"))
    hubs = hubs.groupBy("id").agg(best(F.col("lists").alias("by")).alias("a"), best(F.col("meets").alias("by")).alias("b"))
    own = stage.put(hubs.select("id", F.inline(F.array_distinct(F.concat(F.transform("a", plain), F.transform("b", plain))))), "hubs")
    begun, tried = nodes.select("id", F.col("id").alias("root")), None
    for turn in range(STARS + 1):
        if turn < STARS:
            # stars first: a text with the hubs of its lists, so that a large group is one before pairs are made; of the hubs not
            # looked at the one that shares most lists with the text, and the one that meets most others
            open_ = own.join(begun, "id").join(begun.select(F.col("id").alias("h"), F.col("root").alias("hub_root")), "h").where("root <> hub_root")
            if tried is not None:
                open_ = open_.join(tried.select(F.col("a").alias("h"), F.col("b").alias("id")), ["h", "id"], "left_anti")
            chosen = open_.groupBy("id").agg(F.array_distinct(F.array(F.max_by("h", F.struct("lists", "h")), F.max_by("h", F.struct("meets", "h")))).alias("hs"))
            pairs = stage.put(chosen.select(F.explode("hs").alias("a"), F.col("id").alias("b")), f"stars{turn}")
            if pairs.isEmpty():
                continue
            tried = pairs if tried is None else tried.unionByName(pairs)
        else:  # what meets in a list and is in different groups still
            sketched = nodes.select("id", "n", F.when(F.col("n") <= SHORT, F.col("few")).otherwise(F.col("fps")).alias("sk"))
            rooted = posted.join(begun, "id").join(sketched, "id").select("id", "root", "n", "sk", F.inline("posts"))
            # a list of two whose other halves are apart gives no pair; most lists that unrelated texts share are such
            seen = {"r0": F.min("root"), "r1": F.max("root"), "texts": F.count("*"), "lo": F.min("rest"), "hi": F.max("rest")}
            several = rooted.withColumns({c: f.over(w) for c, f in seen.items()}).where((F.col("r0") != F.col("r1")) & ((F.col("texts") > 2) | near("post", "lo", "hi")))
            left = stage.put(several.drop(*seen), "left").repartition("post")
            n1, n2 = F.col("one.n"), F.col("two.n")
            apart = F.aggregate(F.zip_with("one.sk", "two.sk", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
            shared = F.size(F.array_intersect("one.sk", "two.sk"))
            alike = F.when(F.greatest(n1, n2) <= SHORT, shared >= (n1 + n2 - shared) * F.lit(least) - 1e-9).when(F.least(n1, n2) > SHORT, apart <= _most_apart(least, prints, 4.5)).otherwise(True)
            alike = (F.least(n1, n2) >= F.greatest(n1, n2) * (least - 1e-9)) & alike
            # two longer texts are a row in the first of the lists that they meet in
            meeting = lambda x, q: F.coalesce(*[F.when((mine.bitwiseAND(F.lit(m)) == 0) & (F.bit_count(other) <= OTHER), q * 8 + i + 4 * half) for half, mine, other in _halves(x) for i, m in enumerate(triples)])
            first = F.array_min(F.transform(F.zip_with("one.sk", "two.sk", lambda x, y: x.bitwiseXOR(y)), meeting))
            once = F.when((F.least(n1, n2) > SHORT) & (F.col("one.post") >= 0), first == F.shiftright("one.post", 32).cast("int")).otherwise(True)
            on = (F.col("one.post") == F.col("two.post")) & (F.col("one.id") < F.col("two.id")) & (F.col("one.root") != F.col("two.root")) & near("one.post", "one.rest", "two.rest") & alike & once
            pairs = left.alias("one").join(left.alias("two"), on).select(F.col("one.id").alias("a"), F.col("two.id").alias("b"))
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
        close = _verified(pairs, nodes, source, shingle, least, stage, f"turn{turn}")
        close = close.join(begun.withColumnsRenamed({"id": "a", "root": "one"}), "a").join(begun.withColumnsRenamed({"id": "b", "root": "two"}), "b").select("one", "two")
        whole = connected_components(close, "one", "two").select(F.col("node").alias("root"), F.col("root").alias("smaller"))
        begun = stage.put(begun.join(whole, "root", "left").select("id", F.coalesce("smaller", "root").alias("root")), f"begun{turn}")
    kept = nodes.select("id", "node").join(begun, "id").groupBy("root").agg(F.min("node").alias("node"))
    kept = kept.select("node.k", "node.tag", F.lit(True).alias("first")).alias("n")
    on = F.col("e.k").eqNullSafe(F.col("n.k")) & (F.col("e.tag") == F.col("n.tag"))
    return each.alias("e").join(kept, on, "left").select(F.col("e.k").alias(key), "e.tag", F.coalesce("n.first", F.lit(False)).alias("first"))


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents, by the contract's three words and three bits."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
