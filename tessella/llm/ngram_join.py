"""Exact Jaccard self-join of word shingle sets, and its connected components.

Sets meet in tiles: bands of sizes, cut into parts of the hash range, one tile for each content of a
part. A pair that is similar enough differs in few elements, so with more parts than that, one part at
least is the same in both, and the pair meets. In a tile, hashed bitmap signatures bound the overlap
from above by their bit counts; what is left is decided by intersecting sorted arrays.

What leaves a tile is never a list of its pairs: first a forest of likely links, one a member at most;
then, of tiles whose members are still in several components, the members of open pairs, which are
intersected where they meet and give links for a forest again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, ascii_words, cut, mix, pieces, shingle_hashes, small_batches, stage
from .components import components

#: Members of a tile that are compared in one task; larger tiles are cut.
TILE = 1024
#: Tiles with more members outside their largest component are divided by a further part before they are cut.
DIVIDED = 4 * TILE
#: Representatives whose texts are found by a broadcast of their hashes; more are found by a shuffle.
BROADCAST_TEXTS = 2_000_000
#: Ways to deal elements to parts that are tried before empty parts count as content.
DEALS = 16


@dataclass(frozen=True)
class Bands:
    """Size bands for a least similarity of num / den: partners are in the same band or the next."""

    num: int
    den: int
    starts: np.ndarray = field(init=False, compare=False)
    parts: np.ndarray = field(init=False, compare=False)  # of the tiles of bands k and k + 1
    empty: np.ndarray = field(init=False, compare=False)  # parts that may be empty in both of a pair

    def __post_init__(self):
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(starts[-1] * self.den // self.num + 1)
        parts, empty = [], []
        for low, after in zip(starts, starts[1:]):
            x = after - 1
            most = (x + x * self.den // self.num) * (self.den - self.num) // (self.den + self.num)  # elements in one set only
            n, spare = most + 1, 0
            for _ in range(4):
                mean = n * np.exp(-low / n)
                spare = min(int(np.ceil(mean + 2 * np.sqrt(mean))), 1 + most // 8)
                n = most + 1 + spare
            parts.append(n if most else 0)  # where no element may differ, only equal sets are similar
            empty.append(spare)
        object.__setattr__(self, "starts", np.array(starts, dtype=np.int64))
        object.__setattr__(self, "parts", np.array(parts, dtype=np.int64))
        object.__setattr__(self, "empty", np.array(empty, dtype=np.int64))

    def similar(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def keys(self, elements: np.ndarray, family: int = 0) -> np.ndarray:
        """Keys of the tiles of a sorted set of 64-bit hashes; similar sets share one at least in each ``family``.

        With as many parts as may differ and ``empty`` more, a set that has no more empty parts than that
        agrees with each partner in a part that is not empty. A set with more of them has keys of further deals
        of elements to parts, up to the first deal in which it has few enough: of two partners, the one that
        stops first meets the other there. So empty parts, which unrelated sets share, make no keys.
        """
        band = int(np.searchsorted(self.starts, len(elements), "right")) - 1
        mixed, out = mix(elements + np.uint64(0x9E3779B97F4A7C15)), []
        for space in (band - 1, band):
            n = int(self.parts[space]) if space >= 0 else 0
            if not n:
                continue
            for deal in range(DEALS):
                salt = np.uint64((space * 0x1000003 + 1) + (family * DEALS + deal) * 0x5851F42D4C95)
                if family or deal:
                    part = ((mix(elements ^ mix(np.array([salt]))) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
                    order = np.argsort(part, kind="stable")
                    part, content = part[order], mixed[order]
                else:
                    part, content = ((elements >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), mixed  # a range of the sorted hashes
                first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                out.append(mix(np.add.reduceat(content, first) + mix(part[first] + (salt << np.uint64(20)))))
                if n - len(first) <= self.empty[space]:
                    break
            else:
                none = np.setdiff1d(np.arange(n, dtype=np.uint64), part[first])
                out.append(mix(mix(none + (salt << np.uint64(20))) + np.uint64(7)))
        return np.concatenate(out) if out else elements[:0]


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Parity bitmap: every element flips one bit. Its width is the power of two from twice the size, or 64 bits."""
    width = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    bit = mix(elements + np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)
    flips = (np.bincount(bit.astype(np.int64), minlength=width) & 1).astype(np.uint8)
    return np.packbits(flips, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at a smaller width: bits whose places agree there are added up."""
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0)


class Tile:
    """Sets that meet: their sizes and bitmaps, in an order that is the same wherever they meet."""

    def __init__(self, bands: Bands, nodes: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], labels: np.ndarray):
        order = np.argsort(mix(nodes.view(np.uint64)), kind="stable")
        self.bands, self.order, self.nodes, self.sizes, self.labels = bands, order, nodes[order], sizes[order], labels[order]
        self.words = min(map(len, bits))
        self.table = np.stack([fold(bits[k], self.words) for k in order])

    def partners(self, i: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members before ``i`` of other groups that its bitmap allows, and whether they are surely similar.

        Sure is what lies beyond all that collisions of bits explain.
        """
        at = np.flatnonzero(group[:i] != group[i])
        size, other = self.sizes[i], self.sizes[at]
        small, large = np.minimum(size, other), np.maximum(size, other)
        at = at[small * self.bands.den >= large * self.bands.num]
        if not len(at):
            return at, np.zeros(0, dtype=bool)
        differ = np.bitwise_count(self.table[at] ^ self.table[i]).sum(axis=1, dtype=np.int64)
        # Of the elements in one set only, some fall on the same bit, but none flips more than one.
        most = (self.sizes[at] + size) * (self.bands.den - self.bands.num) // (self.bands.den + self.bands.num)  # such elements, of a similar pair
        allowed = differ <= most
        at, differ, most = at[allowed], differ[allowed], most[allowed]
        hidden = differ.astype(float) ** 2 / (128.0 * self.words)  # pairs of elements on one bit, expected
        return at, differ + 2 * (hidden + 2 * np.sqrt(hidden + 0.25)) <= most

    def forest(self) -> list[tuple[int, int]]:
        """Allowed pairs that would join all that they can; sure ones first. There are fewer than members."""
        group, found, open_ = np.arange(len(self.nodes)), [], []
        for i in range(1, len(group)):
            at, sure = self.partners(i, group)
            for j in at[sure].tolist():
                if group[j] != group[i]:
                    found.append((j, i))
                    group[group == group[j]] = group[i]
            if not sure.all():
                open_.append((i, at[~sure]))
        for i, at in open_:
            for j in at[group[at] != group[i]].tolist():
                if group[j] != group[i]:
                    found.append((j, i))
                    group[group == group[j]] = group[i]
        return found

    def open_groups(self) -> np.ndarray:
        """A number a member: those that allowed pairs across labels connect have the same; -1 without such a pair."""
        group, labels = np.arange(len(self.nodes)), np.unique(self.labels, return_inverse=True)[1]
        met = np.zeros(len(group), dtype=bool)
        for i in range(1, len(group)):
            at, _ = self.partners(i, labels)
            if len(at):
                met[at] = met[i] = True
                for g in np.unique(group[at]).tolist():
                    group[group == g] = group[i]
        return np.where(met, group, -1)

    def links(self, elements: list[np.ndarray]) -> list[tuple[int, int]]:
        """Similar pairs that join all labels that any similar pair joins; ``elements`` in the order of the constructor."""
        sets, group, found = [elements[k] for k in self.order], np.unique(self.labels, return_inverse=True)[1], []
        for i in range(1, len(group)):
            for j in self.partners(i, group)[0].tolist():
                if group[j] != group[i] and self.bands.similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])):
                    found.append((j, i))
                    group[group == group[j]] = group[i]
        return found


def _runs(values: list[np.ndarray]) -> np.ndarray:
    """Where rows differ from the row before in any of ``values``; the first row counts."""
    new = np.zeros(len(values[0]), dtype=bool)
    new[:1] = True
    for v in values:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _name(nodes: np.ndarray) -> int:
    """A 64-bit name of a set of nodes."""
    return int(mix(mix(nodes.view(np.uint64)).sum(keepdims=True, dtype=np.uint64)).view(np.int64)[0])


def _node(elements: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes())).view(np.int64))


def _cells(docs: DataFrame, bands: Bands, n: int) -> DataFrame:
    """Members of tiles that hold two sets or more (cell, node), and a row with ``doc`` for each document.

    ``node`` is the hash of a set: equal sets are one node. Tiles of the same members are one cell.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    doc_type = f"struct<id:{id_type},n:bigint,tid:bigint>"

    def expand(batches):
        ids, seen = WordIds(), set()
        for batch in pieces(batches):
            tids, sizes, nodes, keys, of = batch.column("tid"), [], [], [], []
            for text in batch.column("text").to_pylist():
                elements = shingle_hashes(ids.array(ascii_words(text)), n)
                sizes.append(len(elements))
                node = _node(elements) if len(elements) else None
                nodes.append(node)
                if node is not None and node not in seen:
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(node)
                    k = bands.keys(elements).view(np.int64)
                    keys.append(k)
                    of.append(np.full(len(k), node, dtype=np.int64))
            doc = pa.StructArray.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), tids], names=["id", "n", "tid"])
            yield pa.RecordBatch.from_arrays([tids, pa.array(nodes, pa.int64()), doc], names=["key", "node", "doc"])
            for at in range(0, len(keys), 64):
                k, v = np.concatenate(keys[at : at + 64]), np.concatenate(of[at : at + 64])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v), pa.nulls(len(k), doc.type)], names=["key", "node", "doc"])

    def gather(batches):
        held_key, held_node = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hot: set[int] = set()  # the one key whose members go out as they come
        seen: set[int] = set()

        def out(key, node, last):
            nonlocal held_key, held_node, hot
            starts = _runs([key])
            ends = np.append(starts[1:], len(key))
            cells, members = [], []
            for s, e in zip(starts, ends, strict=True):
                open_end, gone = e == len(key) and not last, int(key[s]) in hot
                if open_end and e - s <= TILE and not gone:
                    break  # the run may go on in the next batch
                if e - s > TILE or open_end or gone:
                    cells.append(key[s:e])
                    members.append(node[s:e])
                    hot = {int(key[s])} if open_end else set()
                elif e - s > 1:
                    name = _name(node[s:e])
                    if name not in seen:
                        if len(seen) > 100_000:
                            seen.clear()
                        seen.add(name)
                        cells.append(np.full(e - s, name))
                        members.append(node[s:e])
            else:
                s = len(key)
            held_key, held_node = key[s:], node[s:]
            return cells, members

        def batch_of(cells, members):
            c, m = np.concatenate(cells), np.concatenate(members)
            return pa.RecordBatch.from_arrays([pa.nulls(len(c), doc_arrow), pa.array(c), pa.array(m)], names=["doc", "cell", "node"])

        doc_arrow = None
        for batch in pieces(batches, 10_000):
            doc_arrow = batch.column("doc").type
            is_doc = batch.column("doc").is_valid()
            rows = batch.filter(is_doc)
            if rows.num_rows:
                yield pa.RecordBatch.from_arrays([rows.column("doc"), pa.nulls(rows.num_rows).cast(pa.int64()), rows.column("node")], names=["doc", "cell", "node"])
            rest = batch.filter(pa.compute.invert(is_doc))
            key = np.concatenate([held_key, rest.column("key").to_numpy()])
            node = np.concatenate([held_node, rest.column("node").to_numpy()])
            if not len(key):
                continue
            keep = _runs([key, node])  # equal sets from several tasks
            key, node = key[keep], node[keep]
            # Only runs of two and more need a look; most keys stand alone.
            same = np.zeros(len(key), dtype=bool)
            same[1:] = key[1:] == key[:-1]
            paired = same.copy()
            paired[:-1] |= same[1:]
            paired[-1] = True
            paired |= np.isin(key, np.array(list(hot), dtype=np.int64))
            found = out(key[paired], node[paired], False)
            if found[0]:
                yield batch_of(*found)
        if len(held_key):
            found = out(held_key, held_node, True)
            if found[0]:
                yield batch_of(*found)

    keyed = docs.mapInArrow(expand, f"key bigint, node bigint, doc {doc_type}")
    met = keyed.repartition("key").sortWithinPartitions("key", "node")
    return met.mapInArrow(gather, f"doc {doc_type}, cell bigint, node bigint")


def _contents(docs: DataFrame, members: DataFrame, nodes: DataFrame, bands: Bands, n: int) -> DataFrame:
    """(node, n, bits, elements, further) of ``nodes``, each from one row of ``docs``; rows repeated in full may give it again.

    ``further`` are keys of another family, by which large cells are divided.
    """
    wanted = members.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("tid", F.col("id").isNull().alias("none"), "id")).alias("row"))
    wanted = cut(wanted.select(F.col("row.tid").alias("w_tid"), F.col("row.id").alias("w_id")).distinct())
    if wanted.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)

    def run(batches):
        ids, seen = WordIds(), set()
        for batch in pieces(batches):
            rows = []
            for tid, text in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if tid not in seen:
                    seen.add(tid)  # one a representative: as many as this task's share of them
                    e = shingle_hashes(ids.array(ascii_words(text)), n)
                    rows.append((_node(e), len(e), bitmap(e).tobytes(), e.astype("<u8").tobytes(), bands.keys(e, 1).view(np.int64)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["node", "n", "bits", "elements", "further"])

    texts = docs.join(wanted, (F.col("tid") == F.col("w_tid")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi").select("tid", "text")
    return texts.mapInArrow(run, "node bigint, n bigint, bits binary, elements binary, further array<bigint>")


def _by_unit(units: DataFrame, bands: Bands, solve, schema: str) -> DataFrame:
    """What ``solve`` (Tile, rows) gives for each unit: rows of ``schema``, bigint columns. Repeated members count once."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        held: list[dict] = []

        def done():
            rows = [r for k, r in enumerate(held) if not k or r["node"] != held[k - 1]["node"]]
            if len(rows) < 2:
                return []
            column = lambda c: np.array([r[c] for r in rows], dtype=np.int64)
            tile = Tile(bands, column("node"), column("n"), [np.frombuffer(r["bits"], dtype=np.uint64) for r in rows], column("label"))
            return solve(tile, rows)

        def emit(found):
            columns = list(zip(*found, strict=True)) if found else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in pieces(batches):
            found = []
            for row in batch.to_pylist():
                if held and row["unit"] != held[0]["unit"]:
                    found += done()
                    held = []
                held.append(row)
            yield emit(found)
        if held:
            yield emit(done())

    return units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(run, schema)


def _verify(pairs: DataFrame, contents: DataFrame, bands: Bands) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sorted arrays intersect enough."""

    def run(batches):
        for batch in pieces(batches):
            ok = []
            for x, y in zip(batch.column("ea").to_pylist(), batch.column("eb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                ok.append(bands.similar(len(np.intersect1d(u, v, assume_unique=True)), len(u), len(v)))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # Only sets that some pair asks for are dealt out.
    asked = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    asked = F.broadcast(asked) if asked.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS else asked
    needed = contents.join(asked, "node", "left_semi").select("node", "elements")
    left, right = needed.toDF("a", "ea"), needed.toDF("b", "eb")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a bigint, b bigint")


def _dealt(by: Column, count: Column) -> Column:
    """A number for each of ``count`` members of a cell, such that TILE members or so have the same."""
    return F.pmod(F.xxhash64("node", by), F.ceil(count / TILE))


def _labelled(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell, node, label) of the cells whose members have several labels, and ``major``, the label of most."""
    rows = cells.join(labels.toDF("node", "label"), "node", "left").select("cell", "node", F.coalesce("label", "node").alias("label"))
    each = rows.groupBy("cell", "label").agg(F.count("*").alias("k"))
    whole = each.groupBy("cell").agg(F.max_by("label", F.struct("k", "label")).alias("major"), F.max("k").alias("n_major"), F.sum("k").alias("n"), F.count("*").alias("labels"))
    return rows.join(whole.filter("labels > 1").drop("labels"), "cell")


def _units(rows: DataFrame) -> DataFrame:
    """(unit, node, label): cells of ``_labelled``, cut so that all pairs of different labels meet in a unit.

    Members of the major label are never compared with each other, so only the others are repeated.
    """
    few = rows.filter(F.col("n") <= TILE).select(F.col("cell").alias("unit"), "node", "label")
    many = rows.filter(F.col("n") > TILE)
    minor = F.col("label") != F.col("major")
    n_minor = F.col("n") - F.col("n_major")
    i, j = F.ceil(F.col("n_major") / TILE), F.ceil(n_minor / TILE)
    own = F.when(minor, _dealt(F.col("cell"), n_minor)).otherwise(_dealt(F.col("cell"), F.col("n_major")))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    # A major cut meets each minor one; a minor cut meets each other cut once.
    with_minor = F.transform(upto(j), lambda k: F.when(minor, F.xxhash64("cell", F.lit(1), F.least(own, k), F.greatest(own, k))).otherwise(F.xxhash64("cell", F.lit(2), own, k)))
    with_major = F.when(minor, F.transform(upto(i), lambda k: F.xxhash64("cell", F.lit(2), k, own))).otherwise(F.array().cast("array<bigint>"))
    return few.union(many.select(F.explode(F.concat(with_minor, with_major)).alias("unit"), "node", "label"))


def _divided(rows: DataFrame, contents: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of ``_labelled``, large ones divided: within them, members meet that share a key of the other family as well."""
    large = rows.filter(F.col("n") - F.col("n_major") > DIVIDED)
    if large.isEmpty():
        return rows
    keys = contents.select("node", F.explode("further").alias("key"))
    parts = large.select("cell", "node").join(keys, "node").select(F.xxhash64("cell", "key").alias("cell"), "node").distinct()
    return rows.filter(F.col("n") - F.col("n_major") <= DIVIDED).unionByName(_labelled(cut(parts), labels))


def _links(cells: DataFrame, contents: DataFrame, bands: Bands) -> DataFrame:
    """(node, label): the components of all similar pairs that share a cell."""
    small = contents.select("node", "n", "bits")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("k"))
    units = cells.join(sizes, "cell").select(F.xxhash64("cell", _dealt(F.col("cell"), F.col("k"))).alias("unit"), "node", F.col("node").alias("label"))

    def likely(tile, rows):
        return [(int(tile.nodes[a]), int(tile.nodes[b])) for a, b in tile.forest()]

    pairs = cut(_by_unit(units.join(small, "node"), bands, likely, "a bigint, b bigint").distinct())
    good = cut(_verify(pairs, contents, bands))
    labels = components(good)

    # Where members of a cell are still in several components, each open pair is decided.
    open_ = cut(_units(_divided(cut(_labelled(cells, labels)), contents, labels)))

    def asked(tile, rows):
        groups = tile.open_groups()
        return [(name, int(tile.nodes[k]), int(tile.labels[k])) for g in np.unique(groups[groups >= 0]) for at in [np.flatnonzero(groups == g)] for name in [_name(tile.nodes[at])] for k in at.tolist()]

    doubtful = cut(_by_unit(open_.join(small, "node"), bands, asked, "unit bigint, node bigint, label bigint").distinct())
    if doubtful.isEmpty():
        return labels

    def decided(tile, rows):
        return [(int(tile.nodes[a]), int(tile.nodes[b])) for a, b in tile.links([np.frombuffer(r["elements"], dtype="<u8") for r in rows])]

    more = cut(_by_unit(doubtful.join(contents.select("node", "n", "bits", "elements"), "node"), bands, decided, "a bigint, b bigint").distinct())
    return labels if more.isEmpty() else components(labels.toDF("a", "b").union(more))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(id, tid, n, node, component) of every row of ``docs``: the text's hash, set size, set and component.

    Two rows link when the Jaccard similarity of their sets of ``n``-word shingles is ``num`` / ``den``
    or more; words are what ASCII white space parts, A-Z lower-cased. A text of fewer words is one shingle.
    The component is the least id that links lead to, the row's own included. Null, empty and blank texts
    have an empty set and link with nothing. Rows with a null id link like others but name no component;
    repeated rows are linked to each other. Texts and shingles are compared by 64-bit hashes. Empty tables
    give no rows; other columns don't matter. The number of a row's links is not counted: within a
    component, pairs that nothing depends on are not compared.
    """
    small_batches(docs.sparkSession)
    bands = Bands(num, den)
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("tid"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = stage(_cells(rows, bands, n))
    members = found.filter("doc is not null").select("doc.*", "node")
    cells = cut(found.filter("doc is null").select("cell", "node").distinct())
    contents = stage(_contents(rows, members, cells.select("node").distinct(), bands, n))
    labels = _links(cells, contents, bands)

    least = members.filter("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(labels.toDF("node", "label"), "node", "left")
    least = cut(least.select("node", F.coalesce("label", "node").alias("label"), "id"))
    named = least.join(least.groupBy("label").agg(F.min("id").alias("component")), "label").select("node", "component")
    alone = members.filter("node is null").withColumn("component", F.col("id"))
    linked = members.filter("node is not null").join(named, "node")
    order = ["id", "tid", "n", "node", "component"]
    return linked.select(*order).union(alone.select(*order))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; see ``link``."""
    return link(docs, doc_id, text, n, num, den).select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row of the least id stays.

    Rows with an empty set all stay. Where a component has null ids only, or the least id has several
    rows, the one of the least text hash stays; of rows with equal id and text, one. Columns of any name
    pass through, but those that begin with ``__keep_``.
    """
    rows = cut(link(docs, doc_id, text, n, num, den))
    full = rows.filter("node is not null").withColumn("group", F.when(F.col("component").isNull(), F.col("node")))
    key = ["component", "group"]
    first = full.groupBy(*key).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tid")).alias("first"))
    same = [full[c].eqNullSafe(first[c]) for c in key]
    beside = full.join(first, same[0] & same[1]).filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("tid") == F.col("first.tid"))))
    drop = cut(beside.select(F.col("id").alias("__keep_id"), F.col("tid").alias("__keep_text")).distinct())
    if drop.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        drop = F.broadcast(drop)
    tid = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    columns = docs.columns
    same_row = (F.col("__keep_tid") == F.col("__keep_text")) & F.col(doc_id).eqNullSafe(F.col("__keep_id"))
    kept = docs.withColumn("__keep_tid", tid).join(drop, same_row, "left_anti")
    copies = full.groupBy("id", "tid").agg(F.count("*").alias("k")).filter("k > 1")
    if not copies.isEmpty():
        again = cut(copies.select(F.col("id").alias("__keep_id"), F.col("tid").alias("__keep_text")))
        kept = kept.join(again, same_row, "left_anti").unionByName(kept.join(again, same_row, "left_semi").dropDuplicates([doc_id, "__keep_tid"]))
    return kept.select(*columns)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, num=85, den=100)
