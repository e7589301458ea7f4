"""Jaccard join on word shingles: subsets for small sets, inverted lists for large ones.

Shingles are put in one global order, rare before frequent. A set of n may lose d = n - ceil(t n) shingles and still reach
the threshold t, so two linked sets share at least l of their first d + l shingles. Small (light) sets emit every 2-subset of
the first d + 2 as a key, C(d + 2, 2) selective keys; large (heavy) sets, and sets that can reach them, emit the first d + 1
shingles, whose rows per key are the inverted lists. The size that divides them minimises the estimated keys and list entries.

Equal sets are one class from the start, and keys that the same classes share are one list. Candidates are then verified in steps, so that a group of near copies is never listed as
all its pairs: in rounds every class is tried against the nearest few leaders of its lists, members from the middle of a group that
link with many; after that classes of different components that still share a key are compared, and there all of them are. Signatures of parity bits rule pairs out inside the join: they never show more difference than there is.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bits import bit_table, may_have
from tidemark.llm.bytetext import mix, shingles, texts_of
from tidemark.llm.graph import components
from tidemark.session import settle

ROWS = ["id", "th", "kind", "n", "cls", "sig", "h", "c", "q"]
SENT = 100_000  # classes that a task remembers to have sent
LEAST_WORDS = 8  # 64-bit words of a signature
PARTS = (2,)  # rounds of leaders: into how many parts each cuts a list, so how many lead it; more suit groups without a middle
NEAR = 8  # leaders of a class whose signatures are compared with its own, those that lead it in most lists
TRIES = 4  # leaders that a class is verified against, the nearest by signature
KEY_WORDS = 1 << 20  # 64-bit words of the bit table of shared keys: 8 MB
ORDER_HINTS = 50_000  # frequent shingles told apart in the global order; the rest are common (found twice in a share of the texts) or not
COMMON_SHARE = 16  # one text of so many is asked for common shingles; that only shapes the order, which may be any


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap that lets a set of n reach the threshold with a set of any size."""
    return -(-n * percent // 100)


def _sets(texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by (text, hash), their texts, and set sizes."""
    h, of = shingles(texts, k)
    n = texts.hi - texts.lo
    ends = np.cumsum(np.bincount(of, minlength=n)) if len(h) else np.zeros(n, np.int64)
    for lo, hi in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
        if hi - lo > 1:
            h[lo:hi].sort()
    if len(h):
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        h, of = h[fresh], of[fresh]
    return h, of, np.bincount(of, minlength=n)


def _class(h: np.ndarray, of: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit id of each set, the same for equal sets."""
    upto = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=upto[1:])
    ends = np.cumsum(n)
    total = upto[ends] - upto[ends - n]
    return mix(total + n.astype(np.uint64)).view(np.int64)


def _signatures(h: np.ndarray, of: np.ndarray, n: np.ndarray) -> pa.Array:
    """Parity bits of each set, at least two for a shingle, in a power of two of 64-bit words."""
    words = np.maximum(LEAST_WORDS, 1 << np.ceil(np.log2(np.maximum(n, 1) / 32)).astype(np.int64))
    words[n == 0] = 0
    first = np.concatenate([[0], np.cumsum(words)])
    bits = np.zeros(first[-1], np.uint64)
    spot = h & (words[of] * 64 - 1).astype(np.uint64)
    # The low bits name the word, so folding a signature in half gives the signature of half the length.
    np.bitwise_xor.at(bits, first[of] + (spot & (words[of] - 1).astype(np.uint64)).astype(np.int64), np.uint64(1) << (h >> np.uint64(58)))
    return pa.ListArray.from_arrays(first.astype(np.int32), pa.array(bits.view(np.int64)))


def _describe(k: int):
    """Two kinds of rows. One per text: id, th (its hash), n, cls, sig. And per slice (kind 1): shingles h of three texts or more with their
    counts c; under a null h, what the rarer lists hold, and their sum of squares q: with them, how long a list is for an average
    entry of those that the order puts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(2)):
                h, of, n = _sets(texts, k)
                values, counts = np.unique(h, return_counts=True)
                often = counts >= 3
                rare, many, texts_n = counts[~often], int(often.sum()) + 1, len(n)
                none = pa.nulls(many, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.lo, texts_n), batch.column(1).slice(texts.lo, texts_n), pa.array(np.zeros(texts_n, np.int32)), pa.array(n.astype(np.int64)), pa.array(_class(h, of, n), mask=n == 0),
                        _signatures(h, of, n), *(pa.nulls(texts_n, pa.int64()) for _ in range(3)),
                    ],
                    ROWS,
                )
                hashes = pa.array(np.append(values[often].view(np.int64), 0), mask=np.append(np.zeros(many - 1, bool), True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(many, batch.schema.field(0).type), pa.nulls(many, pa.int64()), pa.array(np.ones(many, np.int32)), none, none, pa.nulls(many, pa.list_(pa.int64())),
                        hashes, pa.array(np.append(counts[often], rare.sum())), pa.array(np.append(np.zeros(many - 1, np.int64), rare @ rare)),
                    ],
                    ROWS,
                )

    return run


def _shingles(k: int):
    """Every shingle of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(_sets(texts, k)[0].view(np.int64))], ["h"])

    return run


def _ranked(texts, k: int, hints: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Sets in the global order: shingle, text, place in its set; and set sizes and classes."""
    h, of, n = _sets(texts, k)
    cls = _class(h, of, n)
    hashes, counts, common = hints
    weight = may_have(common, h).astype(np.int64)
    flags = np.zeros(1 << 20, bool)
    flags[hashes & np.uint64((1 << 20) - 1)] = True
    maybe = np.flatnonzero(flags[h & np.uint64((1 << 20) - 1)])
    if len(maybe):
        at = np.minimum(np.searchsorted(hashes, h[maybe]), len(hashes) - 1)
        known = hashes[at] == h[maybe]
        weight[maybe[known]] = counts[at[known]]
    # The others keep their order by hash; behind them come the common and the frequent ones of each set, by count and hash.
    frequent = weight > 0
    behind = np.flatnonzero(frequent)
    behind = behind[np.lexsort((h[behind], weight[behind], of[behind]))]
    rest = np.flatnonzero(~frequent)
    first = np.cumsum(n) - n
    plain = np.bincount(of[rest], minlength=len(n))
    spot = np.empty(len(h), np.int64)
    spot[rest] = np.arange(len(rest)) - (np.cumsum(plain) - plain - first)[of[rest]]
    often = n - plain
    spot[behind] = np.arange(len(behind)) - (np.cumsum(often) - often)[of[behind]] + (first + plain)[of[behind]]
    ordered = np.empty_like(h)
    ordered[spot] = h
    return ordered, of, np.arange(len(h)) - first[of], n, cls


def _keys(k: int, percent: int, boundary: int, hints: tuple[np.ndarray, np.ndarray, np.ndarray], shared: np.ndarray | None = None):
    """Rows (key, cls, n) of every set; with `shared`, only those whose key may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in texts_of(batch.column(0)):
                h, of, place, n, cls = _ranked(texts, k, hints)
                spare = n - needed(n, percent)
                keys, owners = [], []
                listed = n * 100 >= percent * (boundary + 1)  # heavy sets, and light ones within their reach
                take = listed[of] & (place <= spare[of])
                keys.append(mix(h[take] + np.uint64(1)))
                owners.append(of[take])
                light = (n <= boundary) & (n >= 2)
                take = light[of] & (place < spare[of] + 2)
                h2, of2 = h[take], of[take]
                width = np.minimum(spare + 2, n)
                for d in np.unique(width[light]):
                    rows = np.flatnonzero(light & (width == d))
                    block = h2[(width == d)[of2]].reshape(len(rows), d)
                    i, j = np.triu_indices(d, 1)
                    keys.append(mix(block[:, i] * np.uint64(0x9E3779B97F4A7C15) + mix(block[:, j])).ravel())
                    owners.append(np.repeat(rows, len(i)))
                key, owner = np.concatenate(keys), np.concatenate(owners)
                if shared is not None:
                    hit = may_have(shared, key)
                    key, owner = key[hit], owner[hit]
                for lo, hi in pairwise([*range(0, len(key), 1 << 16), len(key)]):
                    some = owner[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi].view(np.int64)), pa.array(cls[some]), pa.array(n[some])], ["key", "cls", "n"])

    return run


def _having(wanted: np.ndarray):
    """Rows whose key may be among the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_have(wanted, batch.column(0).to_numpy())))

    return run


def _lists(live: DataFrame) -> DataFrame:
    """`key, cls, n, entries, copies`: keys that the same classes share are one list under the smallest of them, `copies` tells for how many
    it stands, `entries` how many classes it holds. Lists of one class go. Lists are told apart by length, smallest class and the bits of all."""
    own = live.groupBy("key").agg(F.count("*").alias("entries"), F.min("cls").alias("lo"), F.bit_xor("cls").alias("bits")).where("entries > 1")
    kept = settle(own.groupBy("entries", "lo", "bits").agg(F.min("key").alias("key"), F.count("*").alias("copies")).drop("lo", "bits"))
    some = live.mapInArrow(_having(bit_table(kept.select("key"), KEY_WORDS)), "key long, cls long, n long")
    return settle(some.join(kept, "key"))


def _members(k: int, wanted: np.ndarray):
    """Shingle arrays of the classes whose bit is set, mostly once per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            if len(sent) > SENT:
                sent.clear()  # a class may then come again: its rows are made distinct behind
            for texts in texts_of(batch.column(0)):
                h, of, n = _sets(texts, k)
                cls = _class(h, of, n)
                hit = (n > 0) & may_have(wanted, cls)
                for i in np.flatnonzero(hit):
                    if int(cls[i]) in sent:
                        hit[i] = False
                    sent.add(int(cls[i]))
                if not hit.any():
                    continue
                ends = np.concatenate([[0], np.cumsum(n[hit])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.ListArray.from_arrays(ends, pa.array(h[hit[of]].view(np.int64)))], ["cls", "members"])

    return run


def light_boundary(sizes: dict[int, int], percent: int, list_length: float) -> int:
    """Largest size of a light set: the one with the least estimated keys and list entries over the size histogram."""
    if not sizes:
        return 0
    n = np.array(sorted(sizes))
    many = np.array([sizes[x] for x in n], float)
    spare = n - needed(n, percent)
    pairs = np.cumsum(many * (spare + 2) * (spare + 1) / 2)
    lists = many * (spare + 1) * (1 + list_length)
    after = np.concatenate([np.cumsum(lists[::-1])[::-1], [0]])
    best = [pairs[i] + after[np.searchsorted(n * 100, percent * (x + 1))] for i, x in enumerate(n)]
    return int(n[int(np.argmin([after[0], *best])) - 1]) if min(best) < after[0] else 0


def _apart(x: str, y: str) -> F.Column:
    """Parity bits in which two sets differ: at most as many as the shingles that only one of them has."""
    words = F.least(F.size(x), F.size(y))

    def folded(c: str) -> F.Column:  # sizes within reach of each other differ by one doubling at most
        halves = F.zip_with(F.slice(c, F.lit(1), words), F.slice(c, words + 1, words), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(c) > words, halves).otherwise(F.col(c))

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)


def _rough(sig: F.Column) -> F.Column:
    """A signature folded to a quarter of its words, but to no fewer than the least."""

    def half(x: F.Column) -> F.Column:
        words = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda a, b: a.bitwiseXOR(b))

    return F.when(F.size(sig) >= 4 * LEAST_WORDS, half(half(sig))).when(F.size(sig) > LEAST_WORDS, half(sig)).otherwise(sig)


def _near_in_size(percent: int) -> F.Column:
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _possible(percent: int) -> F.Column:
    """Not ruled out by sizes, nor by a signature that shows more shingles of only one set than the threshold allows."""
    return _near_in_size(percent) & (_apart("sa", "sb") * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _verified(pairs: DataFrame, text: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs `a, b` that are linked, by exact intersection."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    members = text.mapInArrow(_members(k, bit_table(ends)), "cls long, members array<long>").join(ends, "cls", "left_semi").dropDuplicates(["cls"])
    left = members.select(F.col("cls").alias("a"), F.col("members").alias("ma"))
    right = members.select(F.col("cls").alias("b"), F.col("members").alias("mb"))
    both = F.size(F.array_intersect("ma", "mb"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= (F.size("ma") + F.size("mb") - both) * percent).select("a", "b")


def _leaders(lists: DataFrame, known: DataFrame, number: int, percent: int, side: dict[str, DataFrame]) -> DataFrame:
    """Pairs `a, b` of a class and a leader of one of its lists, in another component: of the NEAR leaders that lead it in most of
    its lists, the nearest TRIES by signature.

    A list is led by its classes of highest degree, one from each part that a hash cuts it into. The degree, the lengths of a class's lists together,
    is high in the middle of a group of near copies. After the first round only classes outside a list's main component look for leaders, inside it.
    """
    placed = lists.join(known, "cls")
    if number:
        placed = placed.join(_main(placed), "key")
    part = F.pmod(F.xxhash64("cls", F.lit(number)), F.lit(PARTS[number]))
    best = F.max_by(F.struct("cls", "root", "n"), F.struct(F.col("degree"), F.xxhash64("cls", F.lit(-1 - number))))
    led = (placed.where("root = main") if number else placed).groupBy("key", part.alias("part")).agg(best.alias("leader")).drop("part")
    met = (placed.where("root <> main") if number else placed).join(led, "key").where("root <> leader.root")
    met = met.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("leader.cls").alias("b"), F.col("leader.n").alias("nb"), "copies").where(_near_in_size(percent))
    pairs = _nearest(met.groupBy("a", "b").agg(F.sum("copies").alias("keys")), F.desc("keys"), NEAR)
    tried = pairs.join(side["a"], "a").join(side["b"], "b").where(_possible(percent)).select("a", "b", _apart("sa", "sb").alias("apart"))
    tried = _nearest(tried, F.asc("apart"), TRIES)
    return settle(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _main(placed: DataFrame) -> DataFrame:
    """`key, main`: the component that most of a list belongs to, for the lists of several components."""
    mixed = placed.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts"))
    return mixed.where("parts > 1").drop("parts")


def _nearest(pairs: DataFrame, order: F.Column, most: int) -> DataFrame:
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(order, "b"))).where(F.col("nth") <= most).drop("nth")


def _classed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows `id, th, n, cls` of every document (th hashes its text), and `cls, root` of every class: its component."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    text = source.select("text")
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, th long, kind int, n long, cls long, sig array<long>, h long, c long, q long"
    first_pass = settle(source.mapInArrow(_describe(k), kinds))
    described = first_pass.where("kind = 0").select("id", "th", "n", "cls", "sig")
    classes = described.where("cls is not null").groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))

    often = first_pass.where("kind = 1").groupBy("h").agg(F.sum("c").alias("c"), F.sum("q").alias("q"))
    hinted = often.where("h is not null").orderBy(F.desc("c"), "h").limit(ORDER_HINTS).collect()
    rare = often.where("h is null").first()
    hint = np.array([r.h for r in hinted], np.int64).view(np.uint64), np.array([r.c for r in hinted], np.int64)
    by_hash = np.argsort(hint[0])
    share = text.where(F.pmod(F.xxhash64("text"), F.lit(COMMON_SHARE)) == 0).mapInArrow(_shingles(k), "h long")
    common = bit_table(share.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), KEY_WORDS)
    hints = hint[0][by_hash], hint[1][by_hash], common
    # A size class spans 1/64 of its power of two, so the histogram stays small at any length.
    step = F.expr("cast(pow(2, greatest(0, floor(log2(n)) - 6)) as long)")
    sized = described.where("n > 0").groupBy((F.floor(F.col("n") / step) * step).alias("size")).count().collect()
    boundary = light_boundary({int(r.size): int(r["count"]) for r in sized}, percent, rare.q / max(rare.c, 1) if rare else 0)

    kinds = "key long, cls long, n long"
    entries = text.mapInArrow(_keys(k, percent, boundary, hints), kinds)
    shared = entries.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    live = settle(text.mapInArrow(_keys(k, percent, boundary, hints, bit_table(shared, KEY_WORDS)), kinds).distinct())

    lists = _lists(live)

    classes = settle(classes.join(lists.select("cls").distinct(), "cls", "left_semi"))
    side = {x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab"}
    degrees = settle(lists.groupBy("cls").agg(F.sum(F.col("entries") * F.col("copies")).alias("degree")))
    known, links = degrees.withColumn("root", F.col("cls")), None
    for number in range(len(PARTS)):
        found = _verified(_leaders(lists, known, number, percent, side), text, k, percent)
        roots = settle(components(found if links is None else links.unionByName(found))).withColumnRenamed("node", "cls")
        links = roots.select(F.col("cls").alias("a"), F.col("root").alias("b"))
        known = degrees.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))

    # What still meets across components: at least one of a pair is outside the component that most of its list belongs to.
    placed = lists.join(known.drop("degree"), "cls")
    rough = classes.select("cls", _rough(F.col("sig")).alias("sig"))  # this much of a signature rules most out already
    placed = settle(placed.join(_main(placed), "key").join(rough, "cls").select("key", "cls", "n", "root", "main", "sig"))
    x = placed.where("root <> main").select("key", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("sig").alias("sa"))
    y = placed.select("key", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), "main", F.col("sig").alias("sb"))
    apart = (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b")))
    across = x.join(y, "key").where(apart & _possible(percent)).select("a", "b").distinct()
    across = across.join(side["a"], "a").join(side["b"], "b").where(_possible(percent))
    across = settle(across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ties = _verified(across, text, k, percent)
    second = components(links.unionByName(ties))
    every = described.where("cls is not null").select("cls").distinct().join(second.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    return described.drop("sig"), settle(every)


def ngram_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, n_shingles, component_id` for every row: its set's size and the smallest id it reaches by links.

    A set holds the distinct k-word shingles of the text, A-Z lower-cased; fewer than k words are one shingle; null or wordless
    texts have the empty set, link with nothing and are their own component. Rows link when 100 |x & y| >= percent |x | y|
    (percent over 50). Repeated ids and texts stay rows of their own; a null id is passed over when the smallest is taken.
    Other columns are ignored. Classes are told apart by 64-bit hashes.
    """
    described, rooted = _classed(docs, k, percent, id_col, text_col)
    least = described.where("cls is not null").groupBy("cls").agg(F.min("id").alias("least")).join(rooted, "cls")
    named = rooted.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("cls", "component_id")
    return described.join(named, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without their near copies: of each component one row stays, all columns kept.

    It is the row with the smallest id, nulls last, and then the smallest text hash; rows are told apart by id and text, so of two
    different texts under one id, or without one, only that goes which has a near copy. Rows of equal id and text are one. Rows without
    words all stay.
    """
    described, rooted = _classed(docs.select(id_col, text_col), k, percent, id_col, text_col)
    rows = described.where("n > 0").groupBy("cls", "id", "th").agg(F.count("*").alias("copies")).join(rooted, "cls")
    order = F.struct(F.col("id").isNull().alias("nameless"), "id", "th")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    judged = settle(rows.join(best, "root").select("id", "th", "copies", (order != F.col("best")).alias("goes")))
    text_hash = docs.withColumn("_th", F.xxhash64(text_col))
    same = text_hash["_th"].eqNullSafe(F.col("th")) & text_hash[id_col].eqNullSafe(F.col("_id"))
    kept = text_hash.join(judged.where("goes").select(F.col("id").alias("_id"), "th").distinct(), same, "left_anti")
    # Rows that stay and are there more than once: few, so only they are brought together.
    repeated = judged.where("not goes and copies > 1").select(F.col("id").alias("_id"), "th").distinct()
    here = kept["_th"].eqNullSafe(F.col("th")) & kept[id_col].eqNullSafe(F.col("_id"))
    single = kept.join(repeated, here, "left_anti")
    again = kept.join(repeated, here, "left_semi").dropDuplicates([id_col, "_th"])
    return single.unionByName(again).drop("_th")
