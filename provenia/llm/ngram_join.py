"""Similarity join of documents by the Jaccard similarity of their word shingles, through token-group matrices.

Equal sets are one. Two sets of similarity 0.8 share one of the first floor(n / 5) + 1 tokens of each under any order of
all tokens, so only that share of tokens has to meet. Similar sets are put into groups; the matrix holds which tokens
stand in which group's union. A query's overlap with a group's union bounds its overlap with every member, so only
groups whose bound reaches the least overlap are opened, and their members compared exactly.

The first pass takes the tokens with small hashes. A token that few sets share brings those sets' groups together. Sets
that could only meet at tokens that many sets share go through a second pass of their own: over all their tokens, rare
ones first. There whole groups meet the smallest group of each token, what these links leave apart meets again, and
what they connect is not compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import BROADCAST_KEYS, components, cut, ready, tight

SHINGLE = 5
#: Hashes are 63 bits; those below BELOW are in the first pass.
BELOW = int(0.3 * (1 << 63))
#: Sets that share a token up to this many meet at it in the first pass.
FEW = 8
#: Bits of a map of keys that is sent to the tasks: 16 to 32 a key, at most so many (128 MB). Two bits stand for a key.
MAP_BITS = 1 << 30
#: Maps of fewer bits a key let too many other keys through: 5 in 100 at so many.
LEAST_BITS = 8
#: Sets of a group in the second pass.
MEMBERS = 256
#: Sets that a task compares in one go, and columns of a matrix of them.
TOGETHER = 2048
COLUMNS = 4096
#: Whole sets of a written table that one task reads back.
SETS_A_TASK = 2000
#: Sets that are compared, and copies that are left out, are named to the tasks up to this many (some 50 MB); beyond, by shuffle.
BROADCAST_IDS = 1_000_000
#: More copies are named by sorted numbers up to this many (80 MB).
NAMED_ROWS = 10_000_000
#: Members of groups that are compared are sent to the sets up to this many (some 70 MB); beyond, sets are shuffled to them.
BROADCAST_UNITS = 1_000_000

_UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 63-bit hashes of the distinct shingles of a text; of fewer words: one of them all; without words: none."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not parts:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(own) - SHINGLE + 1)
    grams = np.full(n, min(SHINGLE, len(own)), np.uint64)
    for k in range(min(SHINGLE, len(own))):
        grams = (grams ^ own[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        grams ^= grams >> np.uint64(32)
    return np.unique(grams >> np.uint64(1)).view(np.int64)


def set_id(tokens: np.ndarray) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63) if len(tokens) else None


def _first(size: Column) -> Column:
    """So many tokens of a set have to meet."""
    return F.floor(size / 5) + 1


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, sid, size, below, tokens): the set's id and size, its tokens below BELOW or among its first, and how many are below."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            sids, sizes, below, flat = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py())
                sids.append(set_id(own))
                sizes.append(len(own))
                below.append(int(np.searchsorted(own, BELOW)))
                flat.append(own[: max(below[-1], len(own) // 5 + 1)])
            ends = np.cumsum([0, *map(len, flat)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(below, pa.int64()), tokens], names=["doc_id", "sid", "size", "below", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, sid long, size long, below long, tokens array<long>")


def distinct_sets(rows: DataFrame, lows: DataFrame) -> DataFrame:
    """One of the rows of each sid: that of ``lows``. Copies are named to the tasks, so that tokens needn't move."""
    rows = rows.where("sid IS NOT NULL")
    copies = tight(rows.select("sid", "row").join(lows.select("sid", F.col("row").alias("own")), "sid").where("row != own").select("row"))
    held = copies.count()
    if not BROADCAST_IDS < held <= NAMED_ROWS:
        return rows.join(F.broadcast(copies) if held <= BROADCAST_IDS else copies, "row", "left_anti").drop("row")
    named = rows.sparkSession.sparkContext.broadcast(np.sort(copies.toArrow()["row"].to_numpy()))

    def run(batches):
        for batch in batches:
            own = batch.column("row").to_numpy()
            at = np.minimum(np.searchsorted(named.value, own), len(named.value) - 1)
            yield batch.filter(pa.array(named.value[at] != own))

    return rows.mapInArrow(run, rows.schema).drop("row")


def bit_map(keys: DataFrame, held: int) -> np.ndarray:
    """Bits of the hashes in ``keys`` (key), for ``among``."""
    size = min(MAP_BITS, 1 << max(15, (16 * held).bit_length()))
    place = F.col("place").bitwiseAND(size - 1)
    places = keys.select(F.explode(F.array("key", F.shiftright("key", 31))).alias("place"))
    parts = places.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits")).toArrow()  # 4 KB each
    bits = np.zeros((size >> 15, 4096), np.uint8)
    bits[parts["part"].to_numpy()] = np.frombuffer(b"".join(parts["bits"].to_pylist()), np.uint8).reshape(-1, 4096)
    return bits.ravel()


def among(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be one of the map's: true for all of them and few others."""
    found = np.ones(len(keys), bool)
    for place in (keys & 8 * len(bits) - 1, keys >> 31 & 8 * len(bits) - 1):
        found &= (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    return found


def meeting(sets: DataFrame) -> DataFrame:
    """(sid, size, below, common, many, first, few) of the sets with shared tokens.

    few: those that up to FEW sets share, first: the smallest of them, many: the number of the others, common: of those
    below BELOW. Maps of bits tell the tokens apart where the sets lie. A token that they take for another kind is so
    in all sets alike: one set's own token then meets none, a rarer token that counts as common leaves the bounds true.
    """
    counts = cut(sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    known = counts.count()
    often = counts.where(F.col("n") > FEW)
    maps = bit_map(counts.select(F.col("token").alias("key")), known), bit_map(often.select(F.col("token").alias("key")), often.count())
    shared = sets.sparkSession.sparkContext.broadcast(maps)

    def met(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokens = own.flatten().to_numpy()
        keep = np.flatnonzero(among(shared.value[0], tokens))
        return tokens[keep], np.repeat(np.arange(len(own)), own.value_lengths().to_numpy())[keep]

    if LEAST_BITS * known > MAP_BITS:

        def rows(batches):
            for batch in batches:
                tokens, owner = met(batch.column(1))
                yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column(0).take(pa.array(owner))], names=["token", "sid"])

        joined = sets.select("sid", "tokens").mapInArrow(rows, "token long, sid long").join(F.broadcast(counts) if known <= BROADCAST_KEYS else counts, "token")
        many, token = F.col("n") > FEW, F.col("token")
        stats = joined.groupBy("sid").agg(F.count(F.when(many & (token < BELOW), 1)).alias("common"), F.count(F.when(many, 1)).alias("many"), F.min(F.when(~many, token)).alias("first"), F.collect_list(F.when(~many, token)).alias("few"))
        return sets.select("sid", "size", "below").join(stats, "sid")

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            tokens, owner = met(batch.column(3))
            often = among(shared.value[1], tokens)
            common, many = (np.bincount(owner[x], minlength=n) for x in (often & (tokens < BELOW), often))
            tokens, held = tokens[~often], np.bincount(owner[~often], minlength=n)
            ends = np.concatenate([[0], np.cumsum(held)])
            first = pa.array(np.append(tokens, 0)[ends[:-1]], mask=held == 0)  # a set's tokens are sorted
            few = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))
            found = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(common), pa.array(many), first, few], names=["sid", "size", "below", "common", "many", "first", "few"])
            yield found.filter(pa.array(held + many > 0))

    return sets.select("sid", "size", "below", "tokens").mapInArrow(run, "sid long, size long, below long, common long, many long, first long, few array<long>")


def _size_class(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(1.25)))


def opened_groups(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First pass: ((g, h, sid) of the queries of group h that open group g, (sid, g) of all members)."""
    held = met.where("g IS NOT NULL")
    about = held.groupBy("g").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("below").alias("group_below"))
    # a row of the matrix is a token's members, FEW at most, so queries and groups meet there
    rows = held.select("sid", F.col("g").alias("h"), F.explode("few").alias("token")).repartition("token")
    matrix = rows.groupBy("token").agg(F.collect_list(F.struct("sid", "h")).alias("own")).where("size(own) > 1")
    asked = matrix.select("token", "own", F.explode("own").alias("m")).selectExpr("token", "m.sid", "m.h", "explode(filter(array_distinct(own.h), g -> g > m.h OR (g = m.h AND size(filter(own, x -> x.h = g)) > 1))) AS g")
    asked = asked.groupBy("sid", "h", "g").agg(F.sum((F.col("token") < BELOW).cast("long")).alias("hits"))
    # of the tokens below BELOW that a query has in common with a member, hits stand in the matrix, and the others are common ones
    both = F.col("hits") + F.col("common")
    missing = F.col("below") - both <= F.col("size") - F.ceil((F.col("size") + F.col("least")) * 4 / 9)
    apart = 9 * (F.col("below") + F.col("group_below") - 2 * both) <= F.col("size") + F.col("most")
    alike = (5 * F.col("most") >= 4 * F.col("size")) & (5 * F.col("size") >= 4 * F.col("least"))
    opened = asked.join(met.select("sid", "size", "below", "common"), "sid").join(about, "g").where(missing & apart & alike)
    return opened.select("g", "h", "sid"), held.select("sid", "g")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens, crowded) of the sets in ``wanted`` (sid, low, crowded), read from the texts of their smallest doc_ids again.

    A map of bits tells the documents apart where they lie, so no text is shuffled.
    """
    held = wanted.count()
    shared = docs.sparkSession.sparkContext.broadcast(bit_map(wanted.where("low IS NOT NULL").select(F.xxhash64("low").alias("key")), held))

    def run(batches):
        for batch in batches:
            keep = among(shared.value, batch.column(1).to_numpy()) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            sids, flat = [], []
            for text in batch.column(2).take(pa.array(np.flatnonzero(keep))):
                own = shingle_set(text.as_py())
                if len(own):
                    sids.append(set_id(own))
                    flat.append(own)
            ends = np.cumsum([0, *map(len, flat)])
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), tokens], names=["sid", "tokens"])

    doc_id = F.col("doc_id").cast("long")
    found = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("key"), F.col("text").cast("string")).mapInArrow(run, "sid long, tokens array<long>")
    names = wanted.select("sid", "crowded")
    found = tight(found.join(F.broadcast(names) if held <= BROADCAST_IDS else names, "sid").withColumn("row", F.monotonically_increasing_id()), SETS_A_TASK)
    return distinct_sets(found, found.groupBy("sid").agg(F.min("row").alias("row")))


def compared(sets: list[np.ndarray], asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that connect the sets as all links between the asking and the others do, and the others among themselves.

    An asking set whose overlap with the union of the others bounds it below the threshold is left out.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    if asking.any():
        union = np.zeros(column.max() + 1, bool)
        union[column[~asking[owner]]] = True
        overlap = np.bincount(owner, union[column], len(sets)).astype(np.int64)
        least = sizes[~asking].min()
        keep = ~asking | ((5 * overlap >= 4 * sizes) & (9 * overlap >= 4 * (sizes + least)))
    else:
        keep = np.ones(len(sets), bool)
    rows = keep[owner]
    owner, column = owner[rows], column[rows]
    times = np.bincount(column)
    shared = times[column] > 1
    order = np.cumsum(times > 1) - 1
    owner, column = owner[shared], order[column[shared]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int((times > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        both += (dense @ dense.T).astype(np.int64)
    near = 5 * both >= 4 * (sizes[:, None] + sizes[None, :] - both)
    near &= keep[:, None] & keep[None, :]
    fresh = np.ones(len(sets), bool)
    a, b = [], []
    for start in range(len(sets)):
        front = [start] if fresh[start] else []
        fresh[start] = False
        while front:
            at = front.pop()
            reached = np.flatnonzero(near[at] & fresh)
            fresh[reached] = False
            a += [at] * len(reached)
            b += reached.tolist()
            front += reached.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(units: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of the units (g, h, sid, asking): sets that are compared with each other, several units in one go."""
    units = tight(units)
    held = units.count()
    dealt = units.withColumn("part", F.pmod(F.xxhash64("g", "h"), F.lit(max(1, held // TOGETHER))))
    if held <= BROADCAST_UNITS:
        dealt = F.broadcast(dealt)  # so that the tokens move once, to their parts

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("h", "ascending"), ("sid", "ascending")])
        g, h, ids, asking = (table[c].to_numpy() for c in ("g", "h", "sid", "asking"))
        lists = table["tokens"].combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        edges = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1).tolist(), len(g)]
        one, two = [], []
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > 1 and not asking[s:e].all():
                a, b = compared([flat[ends[k] : ends[k + 1]] for k in range(s, e)], asking[s:e])
                one.append(ids[s + a])
                two.append(ids[s + b])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return tight(dealt.join(sets, "sid").groupBy("part").applyInArrow(compare, "a long, b long").distinct())


def units_of(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, h, sid, asking) of the pairs of groups (g, h): the members of g, and those of h, if it is another, asking."""
    members = pairs.join(groups, "g").select("g", "h", "sid", F.lit(False).alias("asking"))
    others = groups.withColumnRenamed("g", "h")
    return members.unionByName(pairs.where("g != h").join(others, "h").select("g", "h", "sid", F.lit(True).alias("asking")))


def _ranked(size: Column):
    """Of a token among a set's first ones: whether it is one of those that must meet a larger set's."""
    return lambda x, i: F.struct(x["n"].alias("n"), x["token"].alias("token"), (i <= F.floor(size / 9)).alias("early"))


def common_links(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Second pass: links that, with ``links``, connect the given sets (sid, tokens) as all their links do."""
    keyed = sets.select("sid", F.explode("tokens").alias("token"))
    counts = cut(keyed.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    each = keyed.join(counts, "token").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("order"), F.min(F.when(F.col("n") > 1, F.col("token"))).alias("least"))
    size = F.size("order")
    each = tight(each.where("least IS NOT NULL").select("sid", "least", _size_class(size).alias("class"), F.filter(F.transform(F.slice("order", 1, _first(size).cast("int")), _ranked(size)), lambda x: x["n"] > 1).alias("first")).where("size(first) > 0"))
    many = each.groupBy("least", "class").agg(F.count(F.lit(1)).alias("sets"))
    slot = F.pmod(F.xxhash64("sid"), F.ceil(F.col("sets") / MEMBERS))
    placed = tight(each.join(many, ["least", "class"]).select("sid", "first", F.xxhash64("least", "class", slot).alias("g"), "class"))
    groups = placed.select("sid", "g")
    held = placed.select("sid", "g", "class", F.explode("first").alias("x")).select("sid", "g", "class", "x.token", "x.early")
    matrix = tight(held.groupBy("token", "g").agg(F.count(F.lit(1)).alias("held")))
    tops = matrix.groupBy("token").agg(F.min("g").alias("h"))
    own = matrix.where("held > 1").select("g", F.col("g").alias("h"))
    met = tight(own.unionByName(matrix.join(tops, "token").where("g != h").select("g", "h")).distinct())
    found = verified(units_of(met, groups), sets)
    # what the smallest groups leave apart: groups that share a token and have members that nothing connects yet
    linked = components(links.unionByName(found)).select(F.col("node").alias("sid"), "component")
    entries = tight(held.join(linked, "sid", "left").groupBy("token", "g", "class", F.coalesce("component", "sid").alias("component")).agg(F.max("early").alias("early")))
    own = F.xxhash64("g", "component", "early")
    torn = entries.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(own).alias("one"), F.sum(F.shiftright(own, 20)).alias("two")).where("lo < hi")
    torn = torn.groupBy("n", "one", "two").agg(F.min("token").alias("token")).select("token")  # tokens of a crowd often stand in just the same groups
    left = tight(entries.join(torn, "token"))
    other = left.select("token", *[F.col(c).alias(f"{c}_h") for c in ("g", "class", "component", "early")])
    # of two sets that link, the sizes differ by a class at most, and the smaller has the token early (2 x 0.8 / 1.8 of it are common)
    sizes = "(class = class_h AND (early OR early_h)) OR (class = class_h + 1 AND early_h) OR (class + 1 = class_h AND early)"
    facing = left.join(other, "token").where(f"component != component_h AND g > g_h AND ({sizes})").select("g", F.col("g_h").alias("h")).distinct()
    done = met.where("g != h").select(F.greatest("g", "h").alias("g"), F.least("g", "h").alias("h"))
    facing = tight(facing.join(done, ["g", "h"], "left_anti"))
    return found if facing.isEmpty() else found.unionByName(verified(units_of(facing, groups), sets))


def near_sets(docs: DataFrame, sets: DataFrame, lows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct sets exactly as all pairs of Jaccard similarity 0.8 or more do."""
    # under the order of rare small, common small and large hashes, a set's first tokens are all rare if it has so many of them
    crowded = (F.col("many") > 0) & (F.col("below") - F.col("common") < _first(F.col("size")))
    group = F.when(F.col("first").isNotNull(), F.xxhash64("first", _size_class(F.col("size"))))
    met = tight(meeting(sets).withColumns({"crowded": crowded, "g": group}))
    opened, groups = opened_groups(met)
    opened = tight(opened)
    pairs = opened.select("g", "h").distinct()
    members = pairs.join(groups, "g").select("g", "h", "sid", F.lit(False).alias("asking"))
    units = tight(members.unionByName(opened.where("g != h").select("g", "h", "sid", F.lit(True).alias("asking"))))
    crowd = met.where("crowded").select("sid", F.lit(True).alias("crowded"))
    named = units.select("sid", F.lit(False).alias("crowded")).unionByName(crowd).groupBy("sid").agg(F.max("crowded").alias("crowded"))
    full = sets_of(docs, tight(named.join(lows.select("sid", "low"), "sid")))
    links = verified(units, full.drop("crowded"))
    return links.unionByName(common_links(full.where("crowded").drop("crowded"), links))



def near_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable by links).

    Null, empty and blank texts have an empty set and are linked with nothing. A null doc_id joins its component but
    names none (alone: component_id null). Repeated rows share a component. Empty input: no rows. Other columns aren't
    read. Shingles are compared by 63-bit hashes, whole sets found equal by 64 bits.
    """
    rows = cut(described(docs)).withColumn("row", F.monotonically_increasing_id())
    lows = cut(rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min("row").alias("row"), F.min("doc_id").alias("low")))
    links = near_sets(docs, distinct_sets(rows.drop("doc_id"), lows), lows)
    found = components(links).select(F.col("node").alias("sid"), "component")
    nodes = lows.join(found, "sid", "left").select("sid", "low", F.coalesce("component", "sid").alias("component"))
    named = nodes.join(nodes.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("sid", "component_id")
    each = rows.select("doc_id", "sid", F.col("size").alias("n_shingles"))
    alone = each.where("sid IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return each.where("sid IS NOT NULL").join(named, "sid").select("doc_id", "n_shingles", "component_id").unionByName(alone)
