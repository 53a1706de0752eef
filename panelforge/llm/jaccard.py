"""Jaccard join on word n-grams: size-banded tiles, hashed bitmap signatures, exact sets.

A document's set is its distinct word shingles as sorted 64-bit hashes. Equal sets are one
node, named by a 64-bit hash of the set.

Tiles. Sizes are cut into bands. In the band of the larger one, two similar sets differ in at
most d hashes; the hash range is cut into more than d parts, so some part is the same in both,
and nodes meet in tiles by the hash of a whole part. A part holds several hashes, so a passage
that many documents share makes no tile of them all. Sets with more empty parts than there are
spare ones also meet by their smallest hashes, one of which similar sets share. Tiles with the
same members are one tile.

Bitmaps. A signature of SIGNATURE bits holds the parity of the hashes on each bit. The count
of differing bits never exceeds the sets' difference, which bounds the overlap from above.

Hubs. Every tile has a hub, the member whose hash in this round is least, so overlapping tiles
mostly have the same one. Each member outside of its hub's class is held against one hub, that
of most of its tiles: by signature, then by exact sets. Links make classes, tiles of one class
are done, and HUBS rounds leave one class of most groups. A round has a pair a member.

The rest. In a tile that still has several classes, members of the largest one need not meet
each other. Its members and the others are cut into chunks, and only pairs of chunks with a
chunk of others meet, so a group with few outsiders makes rows in proportion to its members.
Pairs of different classes that the bitmaps allow are then taken out of the tiles: the same
pair mostly stands in many, and is held against its texts once. Tiles whose least member by
hash is the same mostly have the same pairs, so they go to one task, which names a pair once;
up to about CROWD rows stay together. Where both of a pair have more
than FEW such partners in the tile, such pairs could be many more than the members; these
members meet once more with their texts, in one tile where several have the same such members,
and are intersected inside the tile until one class or no link is left. No pair is dropped.

Null text, or text without words, has an empty set and is linked with nothing, as are rows
with a null id; the latter have no class. Rows that repeat an id are taken one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import documents, give_back, map_values, quoted, step_done, written
from panelforge.llm.graph import components
from panelforge.llm.words import distinct, word_hashes

WORDS, PERCENT, SIGNATURE, BAND, CHUNK, SMALL, HUBS, FEW, CROWD = 4, 85, 2048, 1.25, 512, 16, 3, 32, 4096
TURNS = 3  # slices of the keys that are looked at one after another, so that their shuffles never lie on disk together
SETTLING = 6  # and slices at most of what is open after the hubs, which brings its texts; later ones skip what earlier ones have joined
HELD = 8_000_000  # hashes of sets that a task keeps at once
_FACTOR, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_TILE = ["key", "lo", "hi"]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; one for a text of fewer words."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return np.zeros(0, np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(h))):
        out = out * _FACTOR + h[i : i + n]
    out = _mixed(out)
    if len(h) < k:
        out += np.uint64(len(h))
    return distinct(out)


def _node(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature_of(hashes: np.ndarray) -> bytes:
    parity = (np.bincount((hashes % np.uint64(SIGNATURE)).astype(np.int64), minlength=SIGNATURE) & 1).astype(np.uint8)
    return np.packbits(parity).tobytes()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _band(sizes: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def meeting_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Keys of each set, one of which any other similar set shares.

    A set has the parts of its own band and of every band that a larger similar set can have.
    With d differences at most, d + 1 parts and the spare ones leave more equal parts than
    there are spare ones. Were these all empty, both sets would have more empty parts than
    spare ones, and then both have their smallest hashes as keys too.
    """
    sizes = np.array(list(map(len, sets)), np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner, mixed = np.repeat(np.arange(len(sets)), sizes), _mixed(flat)
    first_band, last_band = _band(sizes), _band(100 * sizes // percent)
    keys, owners = [flat[:0]], [owner[:0]]
    for shift in range(int((last_band - first_band).max(initial=-1)) + 1):
        band = first_band + shift
        d = (100 - percent) * 2 * np.ceil(BAND ** (band + 1)).astype(np.int64) // (100 + percent)
        used = (sizes > 0) & (band <= last_band) & (d > 0)
        spare = d // 10 + (d > 3)
        parts = d + 1 + spare
        chosen = used[owner]
        own = owner[chosen]
        place = (flat[chosen] >> np.uint64(32)) * parts[own].astype(np.uint64) >> np.uint64(32)
        first = np.flatnonzero((np.diff(place, prepend=place[:1]) != 0) | (np.diff(own, prepend=-1) != 0))
        whose = own[first]
        sums = np.add.reduceat(mixed[chosen], first) if len(first) else mixed[:0]
        keys.append(_mixed(sums + place[first] * _FACTOR + band[whose].astype(np.uint64)))
        owners.append(whose)
        for i in np.flatnonzero(used & (parts - np.bincount(whose, minlength=len(sets)) > spare)):
            small = sets[i][: sizes[i] + percent * sizes[i] // -100 + 1]
            keys.append(_mixed(small ^ _mixed(band[i : i + 1].astype(np.uint64) + _FACTOR)))
            owners.append(np.full(len(small), i))
    whose = np.concatenate(owners)
    order = np.argsort(whose, kind="stable")
    return np.split(np.concatenate(keys)[order], np.cumsum(np.bincount(whose, minlength=len(sets)))[:-1]) if len(sets) else []


def described(df: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, node, signature, and keys. Within a task, a set that came before has no keys, nor has a row without an id."""
    seen: set[int] = set()

    def run(rows: list) -> list[list]:
        sets = [shingle_set(r["text"], k) for r in rows]
        nodes = list(map(_node, sets))
        if len(seen) > 200_000:
            seen.clear()
        new = []
        for r, node in zip(rows, nodes, strict=True):
            new.append(r["named"] and node not in seen)
            if new[-1]:
                seen.add(node)
        keys = meeting_keys([s if x else s[:0] for s, x in zip(sets, new, strict=True)], percent)
        return [list(map(len, sets)), nodes, list(map(signature_of, sets)), [x.view(np.int64) for x in keys]]

    rows = df.select("doc_id", F.struct(F.col("doc_id").isNotNull().alias("named"), "text").alias("t"))
    return map_values(rows, ["doc_id"], "t", "n_shingles bigint, node bigint, signature binary, keys array<bigint>", run)


class Members:
    """Members of whole tiles, tile by tile: node, size, signature, class, and side of the tile."""

    def __init__(self, batch, percent: int):
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        self.percent, self.node, self.n, self.c, self.side = percent, column("node"), column("n_shingles"), column("c"), column("side")
        self.bits = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64)
        tile = np.stack([column(c) for c in _TILE])
        self.starts = np.append(np.flatnonzero((np.diff(tile, axis=1, prepend=tile[:, :1] ^ 1) != 0).any(0)), len(self.node))
        self.whole = tile[1] == tile[2]  # else only members of different sides meet

    def _allowed(self, i, j, differ: np.ndarray) -> np.ndarray:
        a, b, p = self.n[i], self.n[j], self.percent
        near = ((100 + p) * differ <= (100 - p) * (a + b)) & (100 * np.minimum(a, b) >= p * np.maximum(a, b))
        return near & (self.c[i] != self.c[j]) & (self.whole[i] | (self.side[i] != self.side[j]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places (i, j), i before j in one tile and apart, that the bitmaps allow, and their differing bits.

        All pairs of a place j come together.
        """
        sizes = np.diff(self.starts)
        small = np.repeat(sizes <= SMALL, sizes)
        ends = np.repeat(self.starts[1:], sizes)
        place = np.flatnonzero(small)
        found = []
        for step in range(1, SMALL):
            i = place[place + step < ends[place]]
            differ = np.bitwise_count(self.bits[i] ^ self.bits[i + step]).sum(1, dtype=np.int64)
            ok = self._allowed(i, i + step, differ)
            found.append((i[ok], i[ok] + step, differ[ok]))
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
        for t in np.flatnonzero(sizes > SMALL):
            start, end = self.starts[t], self.starts[t + 1]
            for a in range(start, end, 64):
                b = min(a + 64, end)
                differ = np.zeros((b - a, b - start), np.int64)
                for w in range(SIGNATURE // 64):
                    differ += np.bitwise_count(self.bits[a:b, w, None] ^ self.bits[None, start:b, w])
                j, i = np.arange(a, b)[:, None], np.arange(start, b)[None]
                y, x = np.nonzero(self._allowed(i, j, differ) & (i < j))
                yield x + start, y + a, differ[y, x]


def _by_tiles(batches: Iterator) -> Iterator:
    """Batches, sorted by tile, dealt anew so that each holds whole tiles."""
    import pyarrow as pa

    held = None
    try:
        for b in batches:
            held = b if held is None else pa.concat_batches([held, b])
            if held.num_rows < 4 * CHUNK:
                continue
            last = [held.column(c)[held.num_rows - 1].as_py() for c in _TILE]
            other = np.zeros(held.num_rows, bool)
            for c, v in zip(_TILE, last, strict=True):
                other |= held.column(c).to_numpy(zero_copy_only=False) != v
            if (cut := int(other.sum())):
                yield held.slice(0, cut)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield held
    finally:
        give_back()


def _unsettled(rows: DataFrame, percent: int) -> DataFrame:
    """What the bitmaps allow to be alike in other classes: pairs (node, other), and members, without other, of tiles where both of a pair have many partners.

    A pair goes by itself if one of the two has FEW partners in the tile or less, so a member brings FEW pairs at most.
    A task that has named a pair leaves it out in its next tiles.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        named: set[tuple[int, int]] = set()
        for b in _by_tiles(batches):
            m = Members(b, percent)
            i, j = np.concatenate([np.stack([i, j]).astype(np.int32) for i, j, _ in m.pairs()], axis=1)
            partners = np.bincount(i, minlength=b.num_rows) + np.bincount(j, minlength=b.num_rows)
            single = np.minimum(partners[i], partners[j]) <= FEW
            many = np.unique(np.concatenate([i[~single], j[~single]]))
            i, j = _first_of_pairs(m.node, i[single], j[single])
            both = list(zip(m.node[i].tolist(), m.node[j].tolist(), strict=True))
            fresh = np.fromiter((x not in named for x in both), bool, len(both))
            i, j = i[fresh], j[fresh]
            if len(named) > 200_000:
                named.clear()
            named.update(both)
            if len(i) + len(many):
                left = b.select([*_TILE, "side", "node"]).take(np.concatenate([i, many]))
                other = pa.array(np.append(m.node[j], np.zeros(len(many), np.int64)), pa.int64(), mask=np.arange(len(i) + len(many)) >= len(i))
                yield pa.RecordBatch.from_arrays([*left.columns, other], names=[*left.schema.names, "other"])

    schema = rows.select(*_TILE, "side", "node", F.col("node").alias("other")).schema
    return rows.mapInArrow(run, schema)


def _first_of_pairs(node: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One (i, j) for each pair of nodes."""
    a, b = node[i], node[j]
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    return i[order[new]], j[order[new]]


class Sets:
    """Exact sets by node, made of texts when asked for; of at most HELD hashes at once, and the last one."""

    def __init__(self, k: int):
        self.k, self.held, self.sets = k, 0, {}

    def get(self, node: int, body) -> np.ndarray:
        return self.sets[node] if node in self.sets else self.of(node, body.as_py())

    def of(self, node: int, body: bytes) -> np.ndarray:
        if node not in self.sets:
            s = shingle_set(zstandard.decompress(body).decode(), self.k)
            if self.held + len(s) > HELD:
                self.sets.clear()
                self.held = 0
            self.sets[node] = s
            self.held += len(s)
        return self.sets[node]


def _settled(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between classes, found by intersecting exact sets inside tiles."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sets = Sets(k)
        for b in _by_tiles(batches):
            m, body, up = Members(b, percent), b.column("body"), {}
            found: list[tuple[int, int]] = []

            def top(c: int) -> int:
                while up.get(c, c) != c:  # noqa: B023
                    c = up[c]  # noqa: B023
                return c

            for i, j, differ in m.pairs():
                for at in np.argsort(differ / (m.n[i] + m.n[j]), kind="stable"):
                    x, y = int(i[at]), int(j[at])
                    ca, cb = top(int(m.c[x])), top(int(m.c[y]))
                    if ca == cb:
                        continue
                    first, second = (sets.get(int(m.node[p]), body[p]) for p in (x, y))
                    if _alike(first, second, percent):
                        up[max(ca, cb)] = min(ca, cb)
                        found.append((int(m.c[x]), int(m.c[y])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], names=["ca", "cb"])

    return rows.mapInArrow(run, "ca bigint, cb bigint")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _bodies(asked: DataFrame, nodes: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """node and body, the compressed text of one of its documents, for the nodes asked for.

    Texts are a fraction of the size of their sets of 64-bit hashes, which don't compress.
    """
    asked = asked.distinct()
    ids = nodes.join(asked, "node").select("rep")

    def load(texts: list) -> list[list]:
        return [[_node(shingle_set(t, k)) for t in texts], [zstandard.compress((t or "").encode(), 1) for t in texts]]

    chosen = df.join(ids, df["doc_id"] == ids["rep"], "left_semi")
    bodies = map_values(chosen, ["doc_id"], "text", "node bigint, body binary", load).select("node", "body")
    return written(bodies.dropDuplicates(["node"]).join(asked, "node", "left_semi"), "bodies")


def _hub_pairs(met: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """a, b, ca and cb: each member with the hub of another class that most of its tiles have."""
    rows = met.join(labels, "node")
    order = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("b"), F.col("c").alias("cb"))
    hubs = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(order).alias("hub")).where("lo < hi").select("key", "hub.b", "hub.cb")
    each = rows.join(hubs, "key").where("c <> cb").groupBy("node", "c", "b", "cb").agg(F.count(F.lit(1)).alias("tiles"))
    best = F.max_by(F.struct("b", "cb"), F.struct("tiles", "b"))
    return each.groupBy(F.col("node").alias("a"), F.col("c").alias("ca")).agg(best.alias("x")).select("a", "ca", "x.*")


def _confirmed(pairs: DataFrame, nodes: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose exact sets are similar enough; bitmaps and sizes sort out most of the others before texts are fetched."""

    def maybe(both: list) -> list[list]:
        a, b = (np.frombuffer(b"".join(x[c] for x in both), np.uint64).reshape(len(both), -1) for c in ("sa", "sb"))
        m, n = (np.array([x[c] for x in both], np.int64) for c in ("na", "nb"))
        differ = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
        return [(((100 + percent) * differ <= (100 - percent) * (m + n)) & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))).tolist()]

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("signature").alias(f"s{c}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb", F.struct("na", "nb", "sa", "sb").alias("both"))
    left = written(map_values(known, ["a", "b", "ca", "cb"], "both", "maybe boolean", maybe).where("maybe").drop("maybe"), "pairs")
    out = _exact(left, bodies, k, percent)
    step_done(left)
    return out


def _exact(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """ca and cb of the pairs (a, b, ca, cb) whose exact sets are similar enough."""
    sets = Sets(k)

    def similar(both: list) -> list[list]:
        return [[_alike(shingle_set(zstandard.decompress(x["x"]).decode(), k), sets.of(x["b"], x["y"]), percent) for x in both]]

    text = lambda c, name: bodies.select(F.col("node").alias(c), F.col("body").alias(name))
    both = pairs.join(text("a", "x"), "a").join(text("b", "y"), "b").select("ca", "cb", F.struct("b", "x", "y").alias("xy"))
    return written(map_values(both, ["ca", "cb"], "xy", "similar boolean", similar).where("similar").select("ca", "cb"), "similar")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels with the classes that links join made one."""
    new = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("c"), "component")
    return written(labels.join(new, "c", "left").select("node", F.coalesce("component", "c").alias("c")), "classes")


def _chunked(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """key, lo, hi, side, node and deal: pairs of chunks of the tiles that have several classes, without pairs inside the largest class.

    deal is the same for tiles that mostly have the same members. A node is the least one of no
    more tiles than it has keys.
    """
    rows = tiles.join(labels, "node")
    sizes = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.xxhash64("node", F.lit(3))).alias("least"))
    sizes = sizes.groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "c")).alias("big"), F.min("least").alias("least")).where("n > big.m")
    crowds = F.ceil(F.sum("n").over(Window.partitionBy("least")) / CROWD)
    deal = F.xxhash64("least", F.pmod(F.xxhash64("key"), crowds)).alias("deal")
    count = lambda n: F.ceil(n / CHUNK).cast("int")
    cut = sizes.select("key", F.col("big.c").alias("big"), count(F.col("big.m")).alias("own"), count(F.col("n") - F.col("big.m")).alias("others"), deal)
    met = rows.join(cut, "key")
    inside = F.col("c") == F.col("big")
    number = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), n).cast("int")
    at = F.when(inside, number(F.col("own"))).otherwise(F.col("own") + number(F.col("others")))
    # chunks of the largest class come first and meet those of the others only, which meet all
    first = F.when(inside, F.col("own")).otherwise(F.lit(0))
    placed = met.select("key", "node", "deal", at.alias("at"), F.explode(F.sequence(first, F.col("own") + F.col("others") - 1)).alias("with"))
    return placed.select("key", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), (F.col("at") > F.col("with")).cast("int").alias("side"), "node", "deal")


def _once(rows: DataFrame) -> DataFrame:
    """rows of tiles, of which one is kept where several have the same members on the same sides."""
    hashes = [F.bit_xor(F.xxhash64("node", "side", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    sums = rows.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("members"), *hashes)
    one = sums.groupBy("members", "h0", "h1", F.col("lo") == F.col("hi")).agg(F.min(F.struct(*_TILE)).alias("tile"))
    return rows.join(one.select("tile.*"), _TILE, "left_semi")


def classes(df: DataFrame, k: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id, the smallest key in reach, for every row."""
    df = df.select(F.col(quoted(key)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    sets = written(described(df, k, percent), "sets")
    usable = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(usable.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "nodes")
    placed = usable.select("node", F.explode("keys").alias("key"))
    met, parts = None, []
    for turn in range(TURNS):
        some = placed.where(F.pmod("key", F.lit(TURNS)) == turn)
        often = written(some.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "often")
        part = written(some.join(often, "key").distinct(), "met")
        step_done(often)
        parts.append(part)
        met = part if met is None else met.unionByName(part)
    docs = written(sets.select("doc_id", "n_shingles", "node"), "members")
    step_done(sets)

    hashes = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in (0, 1)]
    one = met.groupBy("key").agg(F.count(F.lit(1)).alias("members"), *hashes).groupBy("members", "h0", "h1").agg(F.min("key").alias("key"))
    tiles = written(met.join(one, "key", "left_semi").select("key", "node"), "tiles")
    step_done(*parts)
    bodies = _bodies(tiles.select("node"), nodes, df, k)
    labels = nodes.select("node", F.col("node").alias("c"))
    for turn in range(HUBS):
        pairs = written(_hub_pairs(tiles, labels, turn), "hubs")
        links = _confirmed(pairs, nodes, bodies, k, percent)
        step_done(pairs)
        if links.isEmpty():
            break
        labels = _merged(labels, links)

    rest = written(_chunked(tiles, labels), "chunks")
    step_done(tiles)

    def dealt(rows: DataFrame, *by: str) -> DataFrame:  # by the classes known by then
        rows = rows.join(nodes.select("node", "n_shingles", "signature"), "node").join(labels, "node")
        return rows.repartition(*by).sortWithinPartitions(by[0], *_TILE, "node")

    open_ = written(_unsettled(dealt(rest, "deal", "lo", "hi"), percent), "open")
    step_done(rest)
    single = written(open_.where("other IS NOT NULL").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "single")
    last = written(_once(open_.where("other IS NULL").drop("other")), "rest")
    step_done(open_)
    total = nodes.count()

    def slices(table: DataFrame, columns: list[str]) -> Iterator[DataFrame]:
        if (n := table.count()):
            turns = min(SETTLING, 1 + SETTLING * n // total)
            for turn in range(turns):
                yield table.where(F.pmod(F.xxhash64(*columns), F.lit(turns)) == turn)

    asked = single.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = written(bodies.join(asked, "node", "left_semi"), "bodies")
    side = lambda c: labels.select(F.col("node").alias(c), F.col("c").alias(f"c{c}"))
    for some in slices(single, ["a", "b"]):
        links = _exact(some.join(side("a"), "a").join(side("b"), "b").where("ca <> cb"), texts, k, percent)
        if not links.isEmpty():
            labels = _merged(labels, links)
    step_done(single, texts)
    for some in slices(last, _TILE):
        links = written(_settled(dealt(some.join(bodies, "node"), *_TILE), k, percent), "similar")
        if not links.isEmpty():
            labels = _merged(labels, links)
    step_done(last, bodies)

    owners = nodes.select("node", "rep").join(labels, "node")
    least = owners.groupBy("c").agg(F.min("rep").alias("component_id"))
    owners = owners.join(least, "c").select("node", F.col("component_id").alias("c"))
    out = docs.join(owners, "node", "left")
    linked = F.when(F.col("n_shingles") > 0, F.col("c"))
    return out.select(F.col("doc_id").alias(key), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, F.col("doc_id"))).alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
