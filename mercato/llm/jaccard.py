"""N-gram Jaccard join: exact links of documents whose shingle sets are alike.

Words are runs of non-space characters, A-Z lower-cased; a document's set are its distinct
``SHINGLE``-word shingles as 64-bit hashes (a shorter text is one shingle). Two documents
link when 100 * intersection >= ``PERCENT`` * union.

1. Equal sets form a class; further steps see classes only.
2. Candidates without loss. If the smaller of a linked pair has n shingles, the sets differ in
   at most D(n) = (n + n * 100 // PERCENT) // 19 shingles (for 90 percent). Cut the hash range
   into P > D parts: at least P - D parts of the two sets are equal. A class emits a signature
   for each part, for the P of all sizes a partner may have (P goes in steps, so that is one or
   two). Part signatures say far more than single shingles: texts that share a passage don't
   become candidates by it. Empty parts are left out where the P - D to spare allow it.
3. Buckets are the classes of one signature. A batch compares its own ones with the first of each bucket;
   those that link with it are behind it there and stay home, so a group of near copies sends
   a row a batch and signature, whatever its size.
4. Each bucket's members are compared with its least one: its star. A bucket whose members are then all of
   one component needs no more: only connectivity is asked. Nothing is closed that isn't verified,
   so candidates don't grow together.
5. The other buckets are opened, with the classes that stayed home. Those outside of the bucket's largest
   component are compared with all others of the bucket; those inside need no comparison with each
   other. Buckets of the same members are one. Tiles are banded by size: a pair's sizes are in the same band
   or in neighbouring ones; bands are dealt into blocks of ``TILE`` shingles, and each
   block of the former meets each of the latter. No pair is left out.
6. In a tile: a parity bitmap of hashed bits a set, of two to four bits a shingle. Where two bitmaps
   differ, so do the sets, so (n + m - differing bits) / 2 bounds the overlap from above. Only
   bitmaps are sent to tiles; the few pairs that could still link are decided, as stars again, by
   intersecting sorted arrays.

Sets of candidates are made once more from their texts: a bitmap of fixed size tells which texts these may be,
so that no other text is shuffled.

Components are the closure of these links by joins (``graph.components``).

Defined cases: null or blank text has the empty set and links with nothing; a null doc_id is
a document like others, and its component's id is the least id that is not null, if any;
rows of equal doc_id are each judged by their text; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import drop_unused, free_names, freeze, give_back_memory, prepare_workers, read_table
from mercato.llm.graph import components
from mercato.llm.textbytes import NON_SPACE, Texts, chunks, column, mix, word_hashes

SHINGLE = 3
PERCENT = 90
#: shingles of a tile, 8 bytes each
TILE = 2_000_000
#: signatures, or shingles, that a batch compares before it sends them
FLUSH = 1_500_000
LADDER = 1.5
_SETS = "doc_id long, body long, n long, set_id long, sent array<long>, home array<long>, near array<long>"
#: bytes of text cut into shingles at once
TEXT_BYTES = 1 << 20
#: bits that tell candidates' texts
TOLD_BITS = 1 << 24


def shingle_sets(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the rows' places among them."""
    found, h = word_hashes(texts, NON_SPACE)
    many = np.diff(found.row_at)
    rows = len(many)
    out_h, out_row = [], []
    row = np.repeat(np.arange(rows), many)
    if len(h) >= size:
        key = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - size + 1 + k])
        own = row[:len(key)] == row[size - 1:]
        out_h.append(key[own])
        out_row.append(row[:len(key)][own])
    short = np.flatnonzero((many > 0) & (many < size))
    if len(short):
        key = np.full(len(short), 1, np.uint64)
        for k in range(size - 1):
            has = many[short] > k
            key[has] = mix(key[has] * np.uint64(0xC2B2AE3D27D4EB4F) + h[found.row_at[:-1][short[has]] + k])
        out_h.append(key)
        out_row.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    key, of = np.concatenate(out_h), np.concatenate(out_row)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(rows + 1))


def max_difference(n: int, percent: int = PERCENT) -> int:
    """The most shingles in which a set of n and a linked one, not smaller, differ."""
    # i >= percent/100 * u and n + m = u + i, so u - i <= (n + m) * (100 - percent) / (100 + percent)
    return (n + n * 100 // percent) * (100 - percent) // (100 + percent)


def _parts(difference: int) -> int:
    """Parts for a difference: one more, some to spare for empty ones, a step of the ladder."""
    need, p = difference + 1 + spare(difference), 4
    while p < need:
        p = int(p * LADDER)
    return p


def spare(difference: int) -> int:
    return 2 + difference // 25


def most_difference(parts: int) -> int:
    """The largest difference for which sets are cut into so many parts."""
    d = parts - 3 - (parts - 3) // 25
    while d + 1 + 1 + spare(d + 1) <= parts:
        d += 1
    while d + 1 + spare(d) > parts:
        d -= 1
    return d


def part_counts(n: int, percent: int = PERCENT) -> list[int]:
    """The numbers of parts that a set of n is cut into: of each size that a partner not larger
    may have. None if only equal sets link."""
    if max_difference(n, percent) == 0:
        return []
    least = -(-n * percent // 100)
    low, high = _parts(max_difference(least, percent)), _parts(max_difference(n, percent))
    out = [low]
    while out[-1] < high:
        out.append(int(out[-1] * LADDER))
    return out


def signatures(keys: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Of one sorted set."""
    n, out = len(keys), []
    content = mix(keys ^ np.uint64(0xD6E8FEB86659FD93))
    for parts in part_counts(n, percent):
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        upto = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(content, out=sums[1:])
        total = sums[upto[1:]] - sums[upto[:-1]]
        sign = mix(total + np.arange(parts, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
                   + np.uint64(parts) * np.uint64(0xE7037ED1A0B428DB))
        full = upto[1:] > upto[:-1]
        # a pair has parts - difference equal parts or more; with no more empty parts than
        # these less one, one of them is not empty. A partner with so many parts differs in no
        # more than most_difference, however large this set is
        if (~full).sum() <= parts - 1 - min(max_difference(n, percent), most_difference(parts)):
            sign = sign[full]
        out.append(sign)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def describe(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, body, text) -> _SETS: size and id of the set, signatures to send, those for which the
    class stays behind the first of its batch, and the classes it was found to link with."""
    prepare_workers(docs.sparkSession)

    def flush(rows: list, sets: list[np.ndarray], signs: list[np.ndarray]) -> pa.RecordBatch:
        # an equal set sends nothing twice: only the first row of a class carries its lists
        ids, first = np.unique(np.array([r[3] for r in rows], np.int64), return_index=True)
        many = np.array([len(signs[k]) for k in first], np.int64)
        sign = np.concatenate([signs[k] for k in first]) if len(first) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(first)), many)
        order = np.lexsort((owner, sign))
        sign, owner = sign[order], owner[order]
        new = np.ones(len(sign), bool)
        new[1:] = sign[1:] != sign[:-1]
        head = owner[np.maximum.accumulate(np.where(new, np.arange(len(sign)), 0))] if len(sign) else owner
        pairs, which = np.unique(np.stack([owner, head], axis=1)[owner != head], axis=0, return_inverse=True)
        linked = np.array([_linked(sets[first[a]], sets[first[b]], percent) for a, b in pairs.tolist()], bool)
        home = np.zeros(len(sign), bool)
        home[owner != head] = linked[which] if len(pairs) else False
        pairs = pairs[linked]

        def lists(of: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(len(first) + 1))
            values = values[by]
            return [values[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]

        value, place = sign.view(np.int64), dict(zip(first.tolist(), range(len(first)), strict=True))
        kinds = [lists(owner[~home], value[~home]), lists(owner[home], value[home]), lists(pairs[:, 0], ids[pairs[:, 1]])]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        cols += [pa.array([kind[place[k]] if k in place else [] for k in range(len(rows))], pa.list_(pa.int64())) for kind in kinds]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "body", "n", "set_id", "sent", "home", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, signs, total = [], [], [], 0
        for batch in batches:
            ids, bodies = column(batch, "doc_id").to_pylist(), column(batch, "body").to_pylist()
            for texts in chunks(column(batch, "text"), TEXT_BYTES):
                keys, at = shingle_sets(texts, size)
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    own = keys[a:b]
                    rows.append((ids[texts.first + r], bodies[texts.first + r], b - a, set_name(own)))
                    sets.append(own)
                    signs.append(signatures(own, percent))
                    total += max(b - a, len(signs[-1]))
                if total >= FLUSH or len(rows) >= 20_000:
                    yield flush(rows, sets, signs)
                    rows, sets, signs, total = [], [], [], 0
        if rows:
            yield flush(rows, sets, signs)
        give_back_memory()

    return docs.select("doc_id", "body", "text").mapInArrow(run, _SETS)


def set_name(keys: np.ndarray) -> int:
    """A set's id, 0 for the empty set."""
    return int(mix(keys.sum(keepdims=True) * np.uint64(2 * len(keys) + 1)).view(np.int64)[0]) if len(keys) else 0


def bitmap(keys: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The parity bitmap of a set: bit j is the parity of the shingles hashed to j."""
    if bits is None:
        bits = 256
        while bits < 2 * len(keys):
            bits *= 2
    flips = np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) of fewer words: bits that fall together add up to their parity."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Of the same width, that of the largest set or 4096."""
    bits = 256
    while bits < min(4096, max(map(len, sets))):
        bits *= 2
    return np.stack([bitmap(s, bits) for s in sets])


def _linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def search(sets: list[np.ndarray], compare: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first set of each one's component. A pair is looked at if ``compare`` holds for one."""
    n = np.array([len(s) for s in sets])
    maps, root = _bitmaps(sets), np.full(len(sets), -1)
    for seed in range(len(sets)):
        if root[seed] >= 0:
            continue
        root[seed], queue = seed, [seed]
        while queue:
            at = queue.pop()
            left = np.flatnonzero(root < 0)
            if not compare[at]:
                left = left[compare[left]]
            # sizes, then the bound of the bitmaps, then the arrays
            left = left[100 * np.minimum(n[left], n[at]) >= percent * np.maximum(n[left], n[at])]
            differ = np.bitwise_count(maps[left] ^ maps[at]).sum(axis=1, dtype=np.int64)
            most = (n[left] + n[at] - differ) // 2
            left = left[100 * most >= percent * (n[left] + n[at] - most)]
            for k in left:
                if _linked(sets[at], sets[k], percent):
                    root[k] = seed
                    queue.append(int(k))
    return root


def _tile_edges(tiles: DataFrame, percent: int) -> DataFrame:
    """tiles(tile, set_id, keys, compare) -> edges(a, b) that connect what is linked in a tile."""
    def run(table: pa.Table) -> pa.Table:
        ids, first = np.unique(table.column("set_id").to_numpy(), return_index=True)
        keys, asked = table.column("keys"), table.column("compare").to_numpy()
        sets = [np.frombuffer(keys[int(i)].as_buffer(), np.uint64) for i in first]
        compare = np.zeros(len(ids), bool)
        np.logical_or.at(compare, np.searchsorted(ids, table.column("set_id").to_numpy()), asked)
        root = search(sets, compare, percent)
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[own], "b": ids[root[own]]})

    return tiles.groupBy("tile").applyInArrow(run, "a long, b long")


def _told(ids: DataFrame, name: str) -> np.ndarray:
    """A bitmap of ``TOLD_BITS`` bits of the hashes of a column's values: 2 MB at most reach the driver."""
    at = F.pmod(F.xxhash64(name), F.lit(TOLD_BITS)) + 1
    parts = (ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())
    bits = np.zeros(TOLD_BITS // 8 + 4096, np.uint8)
    for r in parts:
        own = np.frombuffer(r["bits"], np.uint8)
        bits[(r["bucket"] - 1) * 4096:(r["bucket"] - 1) * 4096 + len(own)] = own
    return bits


def _keys(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted(doc_id, set_id) -> set_id, n, bits, keys: the bitmaps and the sorted shingles of these classes."""
    told = docs.sparkSession.sparkContext.broadcast(_told(wanted, "doc_id"))
    schema = "of long, set_id long, n long, bits binary, keys binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = column(batch, "at").to_numpy()
            some = np.flatnonzero(told.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if not len(some):
                continue
            part, rows = batch.take(pa.array(some)), []
            ids = column(part, "of").to_pylist()
            for texts in chunks(column(part, "text"), TEXT_BYTES):
                keys, cut = shingle_sets(texts, size)
                for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                    if b > a:
                        rows.append((ids[texts.first + r], set_name(keys[a:b]), b - a, bitmap(keys[a:b]).tobytes(), keys[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["of", "set_id", "n", "bits", "keys"])
        give_back_memory()

    texts = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(TOLD_BITS)).alias("at"), F.col("doc_id").alias("of"), "text")
    # a row of the same doc_id may have another text, and a clash of bits brings other documents
    return (texts.mapInArrow(run, schema).join(wanted.withColumnRenamed("set_id", "own"),
                                               (F.col("set_id") == F.col("own")) & F.col("of").eqNullSafe(F.col("doc_id")), "left_semi")
            .select("set_id", "n", "bits", "keys"))


def _verified(pairs: DataFrame, keys: DataFrame, percent: int, tile: int) -> DataFrame:
    """pairs(a, head, n: of a) -> edges(a, b): those that link. The pairs of a head are a star: members in blocks,
    the head in each block."""
    sizes = pairs.groupBy("head").agg((F.floor(F.sum("n") / tile) + 1).cast("long").alias("blocks"))
    heads = sizes.select(F.col("head").alias("set_id"), "head", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("compare"))
    members = pairs.join(sizes, "head").select(F.col("a").alias("set_id"), "head", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), F.lit(False).alias("compare"))
    tiles = heads.unionByName(members).select("set_id", F.concat_ws("/", "head", "block").alias("tile"), "compare")
    return _tile_edges(tiles.join(keys.select("set_id", "keys"), "set_id"), percent)


def _blocks(of: str, tile: int) -> Column:
    return (F.floor(F.col(of) / tile) + 1).cast("long")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """docs(doc_id, text) -> doc_id, body (hash of the text), n_shingles, component_id."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), "text")
    sets = freeze(describe(plain, size, percent))
    full = sets.where("n > 0")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    sent = full.select(F.col("set_id").alias("a"), "n", F.explode("sent").alias("sign"))
    per = Window.partitionBy("sign")
    rows = sent.withColumn("least", F.min(F.struct("a", "n")).over(per)).withColumn("most", F.max("a").over(per))
    buckets = freeze(rows.where("least.a < most").select("sign", "a", "n", F.col("least.a").alias("head"), F.col("least.n").alias("head_n")))
    drop_unused(docs.sparkSession)       # the signatures dealt out are as large as the texts
    near = full.select(F.col("set_id").alias("a"), F.explode("near").alias("b"))

    alike = 100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")
    stars = freeze(buckets.where((F.col("a") != F.col("head")) & alike).select("a", "head", "n", "head_n").distinct())
    asked = (buckets.select("a").unionByName(near.select("a")).unionByName(near.select(F.col("b").alias("a"))).distinct()
             .join(classes, F.col("a") == F.col("set_id")).select("doc_id", "set_id"))
    keys = freeze(_keys(plain, freeze(asked), size))
    drop_unused(docs.sparkSession)

    edges = freeze(near.unionByName(_verified(stars.select("a", "head", "n"), keys, percent, tile)))
    found = freeze(components(edges))
    drop_unused(docs.sparkSession)

    opened = _opened(full, buckets, classes, found)
    if not opened.isEmpty():
        tiles = _outside_tiles(opened, percent, tile).join(keys.select("set_id", "n", "bits"), "set_id")
        pairs = freeze(_survivors(tiles, percent).distinct())
        del tiles
        drop_unused(docs.sparkSession)
        edges = freeze(edges.unionByName(_verified(pairs, keys, percent, tile)))
        found = freeze(components(edges))
    del keys, opened
    drop_unused(docs.sparkSession)
    named = (found.join(classes.select(F.col("set_id").alias("node"), "doc_id"), "node")
             .groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_class = (classes.join(found, classes["set_id"] == found["node"], "left").join(named, "root", "left")
                .select("set_id", F.coalesce("component_id", "doc_id").alias("component_id")))
    return (sets.join(of_class.withColumnRenamed("set_id", "class"), (F.col("set_id") == F.col("class")) & (F.col("n") > 0), "left")
            .select("doc_id", "body", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _opened(full: DataFrame, buckets: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets of several components, with all their classes: sign, set_id, n, root. One of each lot of
    buckets of the same classes."""
    root = found.select(F.col("node").alias("a"), "root")
    known = buckets.select("sign", "a").distinct().join(root, "a", "left").select("sign", F.coalesce("root", "a").alias("root"))
    # what stayed home is of its batch's component there
    several = known.groupBy("sign").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("sign")
    home = full.select(F.explode("home").alias("sign"), F.col("set_id").alias("a"))
    members = freeze(buckets.select("sign", "a").unionByName(home).join(several, "sign", "left_semi").distinct())
    lots = members.groupBy("sign").agg(F.sum(F.xxhash64("a").cast("decimal(20,0)")).alias("lot"), F.count("*").alias("many")).groupBy("lot", "many").agg(F.min("sign").alias("sign"))
    return freeze(members.join(lots.select("sign"), "sign", "left_semi").join(root, "a", "left")
                  .join(classes.select(F.col("set_id").alias("a"), "n"), "a")
                  .select("sign", F.col("a").alias("set_id"), "n", F.coalesce("root", "a").alias("root")))


def _outside_tiles(opened: DataFrame, percent: int, tile: int) -> DataFrame:
    """Classes outside of their bucket's largest component against all of the size bands that they can link
    with. Blocks of the former meet each block of the latter in a tile."""
    # band(n) and band(m) differ by at most one where m <= n / (percent / 100)
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent) + 1e-9).cast("int")
    main = opened.groupBy("sign", "root").agg(F.count("*").alias("many")).groupBy("sign").agg(F.max(F.struct("many", "root")).alias("m"))
    known = freeze(opened.join(main, "sign").select("sign", "set_id", "root", "n", band.alias("band"), (F.col("root") != F.col("m.root")).alias("outside")))
    asking = (known.where("outside").groupBy("sign", "band").agg(F.sum("n").alias("all_n"))
              .select("sign", "band", _blocks("all_n", tile).alias("ask_blocks")))
    there = known.groupBy("sign", "band").agg(F.sum("n").alias("all_n")).select("sign", "band", _blocks("all_n", tile).alias("own_blocks"))
    asker = (known.where("outside").join(asking, ["sign", "band"])
             .withColumn("k", F.pmod(F.xxhash64("set_id"), F.col("ask_blocks"))))
    # a class meets another one in many buckets: tiles of the same first asker lie in one task, which makes their pairs once
    leads = asker.groupBy("sign", "band", "k").agg(F.min("set_id").alias("lead"))
    # a tile is (asking band, its block, asked band, its block); asked: the same band or a neighbour
    meets = F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)]))
    zero = F.lit(0).cast("long")

    def rows(frame: DataFrame, compare: bool) -> DataFrame:
        place = ("ask_band", "k", "band", "j")
        return frame.select("set_id", "root", F.concat_ws("/", "sign", *place).alias("tile"),
                            F.concat_ws("/", "lead", *place).alias("beside"), F.lit(compare).alias("compare"))

    asked = (known.join(there, ["sign", "band"]).withColumn("ask_band", meets)
             .join(leads.withColumnRenamed("band", "ask_band"), ["sign", "ask_band"])
             .withColumn("j", F.pmod(F.xxhash64("set_id"), F.col("own_blocks"))))
    askers = (asker.join(leads, ["sign", "band", "k"]).withColumnRenamed("band", "ask_band")
              .withColumn("band", F.explode(F.array(*[F.col("ask_band") + d for d in (-1, 0, 1)])))
              .join(there, ["sign", "band"])
              .withColumn("j", F.explode(F.sequence(zero, F.col("own_blocks") - 1))))
    return rows(asked, False).unionByName(rows(askers, True))


def _survivors(tiles: DataFrame, percent: int) -> DataFrame:
    """tiles(tile, beside, set_id, root, compare, n, bits) -> a, head, n (of a): pairs of different components, one
    of them asking, that could link by their sizes and bitmaps. A task gets whole tiles, by ``beside``, one after the other."""
    def pairs_of(ids: np.ndarray, roots: np.ndarray, ask: np.ndarray, n: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = np.array([len(x) // 8 for x in bits])
        groups = {w: np.flatnonzero(words == w) for w in np.unique(words).tolist()}
        maps = {w: np.frombuffer(b"".join(bits[k] for k in rows), np.uint64).reshape(len(rows), w) for w, rows in groups.items()}
        narrow = {(w, v): folded(maps[w], v) for w in maps for v in maps if v <= w}
        left, right = [], []
        for k in np.flatnonzero(ask).tolist():
            for w, rows in groups.items():
                v = min(w, int(words[k]))
                own = folded(np.frombuffer(bits[k], np.uint64).reshape(1, -1), v)
                differ = np.bitwise_count(narrow[w, v] ^ own).sum(axis=1, dtype=np.int64)
                most = np.minimum((n[rows] + n[k] - differ) // 2, np.minimum(n[rows], n[k]))
                fit = rows[(100 * most >= percent * (n[rows] + n[k] - most)) & (roots[rows] != roots[k])]
                left.append(ids[fit])
                right.append(np.full(len(fit), k))
        at = np.concatenate(right) if right else np.zeros(0, np.int64)
        return (np.concatenate(left) if left else ids[:0]), ids[at], at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> np.ndarray:
            tile = table.column("tile").combine_chunks()
            ids, roots, n = (table.column(c).to_numpy() for c in ("set_id", "root", "n"))
            ask, bits = table.column("compare").to_numpy(zero_copy_only=False), table.column("bits").to_pylist()
            code = tile.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                # an asker may stand in its tile twice, as asked too
                own, first = np.unique(ids[a:b], return_index=True)
                asks = np.zeros(len(own), bool)
                np.logical_or.at(asks, np.searchsorted(own, ids[a:b]), ask[a:b])
                first = first + a
                one, two, at = pairs_of(own, roots[first], asks, n[first], [bits[k] for k in first])
                found.append(np.stack([two, one, n[first][at]], axis=1))
            return np.unique(np.concatenate(found), axis=0)      # two texts meet in many tiles

        def told(pairs: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.unique(np.concatenate(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], names=["a", "head", "n"])

        last, pairs = None, [np.zeros((0, 3), np.int64)]
        for batch in batches:
            if not len(batch):
                continue
            tile = column(batch, "tile")
            # rows up to the last tile's first one can be done, if that isn't the tile held
            end = tile[len(batch) - 1].as_py()
            cut = pc.index(tile, end).as_py() if end != last else 0
            if end != last:
                held.append(batch.slice(0, cut))
                whole = pa.Table.from_batches([h for h in held if len(h)], batch.schema)
                if len(whole):
                    pairs.append(finish(whole))
                    if sum(map(len, pairs)) > FLUSH:
                        yield told(pairs)
                        pairs = pairs[:1]
                held, last = [], end
            held.append(batch.slice(cut))
        if held:
            pairs.append(finish(pa.Table.from_batches(held)))
        yield told(pairs)
        give_back_memory()

    order = (tiles.select("tile", "set_id", "root", "compare", "n", "bits", "beside").repartition("beside")
             .sortWithinPartitions("tile").drop("beside"))
    return order.mapInArrow(run, "a long, head long, n long")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with the document of the smallest id of each component; rows of equal doc_id
    and text are one document."""
    # texts are dealt out once: by the columns that rows of one document agree in
    own_id, no_id, body = key = free_names(docs.columns, "_id", "_no_id", "_body")
    of = F.col("doc_id").cast("long")
    kept = (join(docs, size, percent).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.coalesce(of, F.lit(0)).alias(own_id), of.isNull().alias(no_id), F.col("body").alias(body)))
    keyed = docs.withColumns({own_id: F.coalesce(of, F.lit(0)), no_id: of.isNull(), body: F.xxhash64("text")})
    return keyed.join(kept, key, "left_semi").dropDuplicates([*key, "doc_id"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
