"""Exact Jaccard join of n-gram sets by a partitioned universe and the pigeonhole principle.

Equal sets are one representative. In a band of sizes [2**k, 2**(k+1)) the universe of shingles is hashed into m
segments. If sets of l and L >= l elements reach the threshold they differ in at most
H = (l + L) * (100 - p) / (100 + p) elements; so of any units that are worth more than H in all, one must agree: a segment's
subset (worth 1: equal), or, in the first segments of each band, its one-deletion neighbourhood besides (worth 1 more: one element apart).
An empty subset has no neighbourhood and is worth 2 there, as it also finds subsets of one element. Every set is indexed
under all its units. A set probes for partners as large as itself or larger, in its band and the next, and the
allocation is by cost: how many sets share each unit is counted over the corpus, and the dearest units are
dropped as long as the others are worth more than H. What remains is verified exactly.

A bucket is not expanded into all pairs: members are held against the bucket's hub by sketches. A sketch has a bit for
the parity of the elements that fall there, so the bits in which two sketches differ are a distance, and never more than the elements in which the
sets differ. Of two members that link, which are within H of one another, either both are within 2 H of the hub, or both
further than H: the near ones of a hub form a group, and the far ones of the bucket get another hub, and at last form a group too. Groups are
searched by blocks of sketches, then of sets, for links between components, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut, forget, own_name, slices, small, union, without
from .components import components
from .textops import LOWER, Words, mix

MAX_BROADCAST_ROWS = 1_000_000
#: Sketches, and sets, that a task compares with as many others at once.
SKETCHES, BLOCK = 1000, 250
ROWS_A_BATCH = 500
#: Bytes of text of which sets are made at once.
TEXT_BYTES = 300_000
#: Hubs that a bucket gets one after the other, and members that go with one copy of their hub.
ROUNDS, MEMBERS = 2, 1000
#: Bits of a sketch for each element of the largest set of its band; it can be folded once, for the band below.
BITS_AN_ELEMENT = 4


def sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as hashes in order of document, and the n + 1 bounds."""
    w = Words(text, LOWER)
    s, d = w.shingles(k)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(text) + 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Scheme:
    """Bands, segments and bounds for a threshold of p percent."""

    def __init__(self, percent: int):
        self.p = percent

    def partner(self, size):
        """The largest partner of a set of that size."""
        return size * 100 // self.p

    def apart(self, size, other):
        """The most elements in which sets that reach the threshold differ."""
        return (size + other) * (100 - self.p) // (100 + self.p)

    def segments(self, band):
        """Segments of a band, some more than the bound asks for so that the dearest need not be probed, and how many of them, the first ones, have neighbourhoods."""
        top = (2 << band) - 1
        m = (self.apart(top, top) + 1) * 112 // 100 + 2
        return m, np.minimum(m, m // 32 + 2)


def units(s: np.ndarray, bounds: np.ndarray, scheme: Scheme, cross: bool) -> dict[str, np.ndarray]:
    """The rows of an index (cross: of the probes into the next band): doc, sig, unit, slack, charge (what dropping the unit takes from the slack)."""
    size = np.diff(bounds)
    own = np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)
    top = (2 << own) - 1
    if cross:
        use = (size > 0) & (scheme.partner(size) > top)
        band, most = own + 1, scheme.partner(size)
    else:
        use = size > 0
        band, most = own, np.minimum(scheme.partner(size), top)
    need = scheme.apart(size, most) + 1
    m, deep = scheme.segments(band)
    # Sets of the band below fill the segments less, so more units are common ones: half as many again leave enough of the others.
    shown = np.where(cross, np.minimum(m, need * 3 // 2 + 2), m) * use
    slack = shown + np.minimum(deep, shown) - need
    doc = np.repeat(np.arange(len(size)), size)
    keep = use[doc]
    e, doc = s[keep], doc[keep]
    seg = ((mix(e * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    inside = seg < shown[doc]
    e, doc, seg = e[inside], doc[inside], seg[inside]
    first = np.concatenate([[0], np.cumsum(shown)])
    own_sum = mix(e ^ np.uint64(0xA0761D6478BD642F))
    total = np.zeros(first[-1], np.uint64)
    np.add.at(total, first[doc] + seg, own_sum)
    empty = np.bincount(first[doc] + seg, minlength=first[-1]) == 0
    who = np.repeat(np.arange(len(size)), shown)
    place = np.arange(first[-1]) - first[who]
    salt = mix((band[who] * (1 << 24) + place).astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))
    near = seg < deep[doc]
    d, g = doc[near], seg[near]
    at = first[d] + g
    out = {
        "doc": (who, d),
        "sig": (mix(total + salt), mix(total[at] - own_sum[near] + salt[at])),
        "unit": (place * 2, g * 2 + 1),
        "slack": (slack[who], slack[d]),
        "charge": (np.where((place < deep[who]) & empty, 2, 1), np.ones(len(d), np.int64)),
    }
    return {k: np.concatenate(v) for k, v in out.items()}


def sketches(s: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set a bit for each place that an odd number of elements falls on, at the width of the next band."""
    size = np.diff(bounds)
    width = np.maximum(64, BITS_AN_ELEMENT * 2 << np.floor(np.log2(np.maximum(size, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(width)])
    doc = np.repeat(np.arange(len(size)), size)
    place = mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & (width[doc] - 1).astype(np.uint64)
    odd = np.zeros(first[-1], np.uint8)
    np.bitwise_xor.at(odd, first[doc] + place.astype(np.int64), 1)
    data = np.packbits(odd, bitorder="little")
    return [data[a // 8 : b // 8].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def folded(some: list[pa.Scalar], band: int) -> list[np.ndarray]:
    """Sketches at the width of a band, or of the narrowest: their halves laid on one another."""
    out = [np.frombuffer(x.as_buffer(), np.uint64) for x in some]
    words = min(max(1, (BITS_AN_ELEMENT << band) // 64), *map(len, out))
    for i, x in enumerate(out):
        while len(x) > words:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        out[i] = x
    return out


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, f1, f2 (a 128-bit fingerprint of the set), one row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, limit=TEXT_BYTES):
            s, b = sets(text, k)
            sums = []
            for salt in (0x9FB21C651E98DF25, 0xC13FA9A902A6328F):
                c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s ^ np.uint64(salt)), dtype=np.uint64)])
                sums.append(c[b[1:]] - c[b[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(b)), _signed(sums[0]), _signed(sums[1])], names=["doc_id", "n_shingles", "f1", "f2"])

    return docs.select("doc_id", "text").mapInArrow(on, f"doc_id {kind}, n_shingles long, f1 long, f2 long")


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch, text in slices(batches, limit=TEXT_BYTES):
            s, b = sets(text, k)
            ids = batch.column(0).to_numpy()
            for cross in (False, True):
                r = units(s, b, scheme, cross)
                for i in range(0, len(r["doc"]), 200_000):
                    part = {n: v[i : i + 200_000] for n, v in r.items()}
                    tag = (part["unit"] * 2 + cross) * 2 + part["charge"] - 1
                    yield pa.RecordBatch.from_arrays([_signed(part["sig"]), pa.array(ids[part["doc"]]), pa.array(tag.astype(np.int32)), pa.array(part["slack"].astype(np.int32))], names=["sig", "id", "tag", "slack"])

    return docs.select("doc_id", "text").mapInArrow(on, "sig long, id long, tag int, slack int")


def _buckets(sigs: DataFrame) -> DataFrame:
    """(sig, id, cross, probe, hub): rows of buckets with two sets or more and at least one probe, after allocation by cost."""
    shared = sigs.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1")
    shared = cut(shared.select("sig", "id", F.col("tag").bitwiseAND(2) > 0, F.col("tag").bitwiseAND(4) > 0, F.shiftright("tag", 3), F.col("tag") % 2 + 1, "slack", "n").toDF("sig", "id", "cross", "near", "seg", "charge", "slack", "n"), "jaccard-shared")
    # All of a set's units meet once; a neighbourhood counts only with its segment, so it costs at least as much and goes first.
    unit, units_ = Window.partitionBy("id", "cross", "seg"), Window.partitionBy("id", "cross")
    rows = shared.repartition("id").withColumn("c", F.when(F.col("near"), F.sum(F.col("n") - 1).over(unit)).otherwise(F.col("n") - 1))
    dear = units_.orderBy(F.desc("c"), F.desc("near"), "seg", "sig")
    first = ~F.lag(F.struct("near", "seg")).over(dear).eqNullSafe(F.struct("near", "seg"))
    rows = rows.withColumn("charge", F.when(first, F.col("charge")).otherwise(0))
    rows = rows.withColumn("probe", F.sum("charge").over(dear.rowsBetween(Window.unboundedPreceding, Window.currentRow)) > F.col("slack"))
    out = cut(_with_hubs(rows.where("probe or not cross").select("sig", "id", "cross", "probe")), "jaccard-buckets")
    forget(shared)
    return out


def _with_hubs(rows: DataFrame) -> DataFrame:
    """Buckets of two or more with a probe, and a hub for each: the least id that probes. So the buckets of one group have few hubs, and a bucket is done when all that probe it have been its hub."""
    over = Window.partitionBy("sig")
    rows = rows.withColumns({"hub": F.min(F.when(F.col("probe"), F.col("id"))).over(over), "low": F.min("id").over(over), "high": F.max("id").over(over)})
    return rows.where("hub is not null and low < high").drop("low", "high")


def _of_texts(ids: DataFrame, docs: DataFrame, k: int, what: str) -> DataFrame:
    """(id, n, data): the sets of the documents named, made again from their texts: as ascending hashes (elements) or as sketches."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, limit=TEXT_BYTES):
            s, b = sets(text, k)
            data = sketches(s, b) if what == "sketches" else [s[b[i] : b[i + 1]].tobytes() for i in range(len(text))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(b)), pa.array(data, pa.binary())], names=["id", "n", "data"])

    return cut(docs.join(small(ids, MAX_BROADCAST_ROWS), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(make, "id long, n long, data binary"), f"jaccard-{what}")


def _judged(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """Pairs of hub and member (a, b, cross) with the band, and: may (they may link), near, far (see above)."""
    x = sketch.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("data").alias("x"))
    y = sketch.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("data").alias("y"))

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)
        for batch in batches:
            na, nb, cross = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 2))
            band = np.floor(np.log2(nb)).astype(np.int64) + cross
            d = np.array([np.bitwise_count(np.bitwise_xor(*folded([x, y], k))).sum() for x, y, k in zip(batch.column(5), batch.column(6), band.tolist(), strict=True)], np.int64)
            top = (2 << band) - 1
            most = scheme.apart(top, top)
            may = np.maximum(d, np.abs(na - nb)) <= scheme.apart(na, nb)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(band.astype(np.int32)), pa.array(may), pa.array(d <= 2 * most), pa.array(d > most)], names=["a", "b", "cross", "band", "may", "near", "far"])

    both = pairs.join(y, "b").join(x, "a").select("a", "b", "cross", "na", "nb", "x", "y")
    with arrow_rows(pairs.sparkSession, ROWS_A_BATCH):
        return cut(both.mapInArrow(on, "a long, b long, cross boolean, band int, may boolean, near boolean, far boolean"), "jaccard-judged")


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Members b come behind their hub a in one sorted stream; a hub with many members is copied, so that they are dealt over tasks."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("copies"))
    member = pairs.join(small(hubs, MAX_BROADCAST_ROWS), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"))
    member = docs.join(small(member, MAX_BROADCAST_ROWS), docs["doc_id"] == F.col("b")).select("a", "copy", "b", "text")
    hub = docs.join(small(hubs, MAX_BROADCAST_ROWS), docs["doc_id"] == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"), "text")

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch, text in slices(batches, limit=TEXT_BYTES):
            s, bounds = sets(text, k)
            found = []
            for i, (a, copy, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)):
                own = s[bounds[i] : bounds[i + 1]]
                if b is None:
                    if at != (a, copy):
                        at, held = (a, copy), []
                    held.append(own)
                elif any(reach(x, own, percent) for x in held):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], pa.int64()) for n in (0, 1)], names=["a", "b"])

    rows = member.union(hub).repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first())
    return cut(rows.mapInArrow(on, "a long, b long").distinct(), "jaccard-linked")


def reach(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two ascending arrays of different elements, as sets, reach the threshold."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    if not len(y) or 100 * len(y) < percent * len(x):
        return False
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def spanning(hit: np.ndarray) -> np.ndarray:
    """For the rows and columns of a matrix of links: the least row of their component, or -1 without a link. So links leave a task as trees."""
    n = hit.shape[0]
    row = np.where(hit.any(1), np.arange(n), n)
    while True:
        column = np.where(hit, row[:, None], n).min(0, initial=n)
        new = np.minimum(row, np.where(hit, column[None, :], n).min(1, initial=n))
        if (new == row).all():
            out = np.concatenate([row, column])
            return np.where(out == n, -1, out)
        row = new


def sketches_in_block(rows: pa.Table, percent: int) -> pa.Table:
    """Ids of a pair of blocks (columns left, band, id, component, n, data) that may link with one of another component."""
    scheme, left = Scheme(percent), rows.column("left").to_numpy(zero_copy_only=False)
    ids, component, n = (rows.column(c).to_numpy() for c in ("id", "component", "n"))
    data = np.stack(folded(list(rows.column("data").combine_chunks()), int(rows.column("band").to_numpy().min())))
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    hit = np.zeros(len(ids), bool)
    for i in l.tolist():
        fits = r[(component[r] != component[i]) & (np.abs(n[r] - n[i]) <= scheme.apart(n[r], n[i]))]
        good = fits[np.bitwise_count(data[fits] ^ data[i]).sum(1) <= scheme.apart(n[fits], n[i])]
        hit[good] = True
        hit[i] |= len(good) > 0
    return pa.table({"id": pa.array(ids[hit], pa.int64())})


def links_in_block(rows: pa.Table, percent: int) -> pa.Table:
    """Links, as trees, between the sets of a pair of blocks (columns left, id, component, data) that are in different components. Only shared elements are laid out as a matrix, some rows at a time."""
    ids, component = rows.column("id").to_numpy(), rows.column("component").to_numpy()
    left = rows.column("left").to_numpy(zero_copy_only=False)
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("data").combine_chunks()]
    size = np.array([len(x) for x in parts], np.int64)
    values, column, times = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(parts)), size)
    keep = times[column] > 1
    doc, column = doc[keep], np.unique(column[keep], return_inverse=True)[1]
    both = np.zeros((int(left.sum()), int((~left).sum())), np.float32)
    row = np.where(left, np.cumsum(left), np.cumsum(~left)) - 1
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    step = max(1, 20_000_000 // len(parts))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        d, c = doc[a:b], column[a:b] - low
        x, y = np.zeros((both.shape[0], step), np.float32), np.zeros((both.shape[1], step), np.float32)
        one = left[d]
        x[row[d[one]], c[one]] = 1
        y[row[d[~one]], c[~one]] = 1
        both += x @ y.T
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    hit = (100 * both >= percent * (size[l][:, None] + size[r][None, :] - both)) & (both > 0) & (component[l][:, None] != component[r][None, :])
    to = spanning(hit)
    at = np.concatenate([l, r])[to >= 0]
    return pa.table({"a": pa.array(ids[l][to[to >= 0]]), "b": pa.array(ids[at])})


def _blocks(groups: DataFrame, label: DataFrame, most: int) -> DataFrame:
    """Pairs of blocks of about `most` members of each group (g, band, id, asks, main): rows (g, i, j, left, band, id, component). On the left are members that ask, on the right all; where a group has a `main`, only those outside its component ask."""
    groups = groups.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    groups = groups.join(label.toDF("main", "mc"), "main", "left").withColumn("asks", F.expr("asks and (main is null or component <> coalesce(mc, main))"))
    count = groups.groupBy("g").agg(F.sum(F.col("asks").cast("int")).alias("n_left"), F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("n_left > 0 and low < high")
    blocks = lambda n: F.ceil(F.col(n) / most).cast("int")
    member = groups.join(count.drop("low", "high"), "g").withColumns({"nl": blocks("n_left"), "nr": blocks("n"), "h": F.xxhash64("id")})
    left = member.where("asks").select("g", F.pmod("h", "nl").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), F.lit(True).alias("left"), "band", "id", "component")
    right = member.select("g", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod("h", "nr").alias("j"), F.lit(False).alias("left"), "band", "id", "component")
    return left.union(right)


def _group_links(groups: DataFrame, links: DataFrame, sketch: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between members (g, band, id, asks, main) of one group that are in different components: sketches say which members may have some, their sets say which they are. A task holds two blocks."""
    label = components(links)
    with arrow_rows(docs.sparkSession, ROWS_A_BATCH):
        rows = _blocks(groups, label, SKETCHES).join(sketch, "id").select("g", "i", "j", "left", "band", "id", "component", "n", "data")
        may = cut(rows.groupBy("g", "i", "j").applyInArrow(lambda t: sketches_in_block(t, percent), "id long").distinct(), "jaccard-may")
        made = _of_texts(may.toDF("doc_id"), docs, k, "elements")
        rows = _blocks(groups.join(may, "id", "left_semi"), label, BLOCK).join(made.drop("n"), "id").select("g", "i", "j", "left", "id", "component", "data")
        found = cut(rows.groupBy("g", "i", "j").applyInArrow(lambda t: links_in_block(t, percent), "a long, b long").distinct(), "jaccard-found")
    forget(made, may, label)
    return found


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that is reachable by links, itself included), set_id (least doc_id of the equal sets).

    docs: doc_id (whole numbers), text; one row per input row. Words are lower-case (A-Z), a set is the distinct k-word shingles; a
    text of fewer words is one shingle; null, empty and wordless texts have no shingles and link with nothing. Rows with a null
    doc_id get the component of the rows with the same set if there are any, else null. Rows that share a doc_id keep their own sets,
    and a link of one of them holds for the id. Other columns are not looked at; an empty table gives an empty result.
    """
    # Texts go to Python in small batches, so that a worker holds little beside the executor's heap.
    with arrow_rows(docs.sparkSession):
        return _components_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)


def _components_of(docs: DataFrame, k: int, percent: int) -> DataFrame:
    meta = cut(_describe(docs, k), "jaccard-sizes")
    key = ["n_shingles", "f1", "f2"]
    groups = cut(meta.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("set_id"), F.count("*").alias("copies")), "jaccard-groups")
    twins = groups.where("copies > 1").drop("copies")
    spare = meta.join(twins, key).where("doc_id <> set_id or doc_id is null").select("doc_id").union(meta.where("n_shingles = 0").select("doc_id")).distinct()
    # An id with several rows may hold a needed set and a spare one; then all of its rows take part.
    needed = groups.where("set_id is not null").select(F.col("set_id").alias("doc_id"))
    spare = cut(spare.join(needed, "doc_id", "left_anti"), "jaccard-spare")
    reps = docs.where("doc_id is not null").join(small(spare, MAX_BROADCAST_ROWS), "doc_id", "left_anti")
    buckets = _buckets(_signatures(reps, k, percent))
    sketch = _of_texts(buckets.select(F.col("id").alias("doc_id")).distinct(), reps, k, "sketches")
    judged, links = [], []
    for _ in range(ROUNDS):
        pairs = buckets.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"), "cross").distinct()
        judged.append(_judged(pairs, sketch, percent))
        may = judged[-1].where("may").select("a", "b").distinct()
        # Most members link with their least hub; then what is in one component already needs no look.
        links.append(_linked(may.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), reps, k, percent))
        label = components(union(links))
        of = lambda c: label.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))  # noqa: B023, E731
        apart = may.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce("ca", "a").eqNullSafe(F.coalesce("cb", "b"))).select("a", "b")
        links.append(_linked(cut(apart, "jaccard-apart"), reps, k, percent))
        far = judged[-1].where("far").select(F.col("a").alias("hub"), F.col("b").alias("id"), "cross")
        left = cut(_with_hubs(buckets.join(far, ["hub", "id", "cross"], "left_semi").select("sig", "id", "cross", "probe")), "jaccard-far")
        forget(buckets, label)
        buckets = left
    near = union([x.where("near").select("a", "b", "band") for x in judged])
    # A hub that is near a hub of less id joins its group, so that a cluster is one group.
    least = near.groupBy(F.col("b").alias("a"), "band").agg(F.min("a").alias("c"))
    near = near.join(least, ["a", "band"], "left").select(F.least("a", F.coalesce("c", "a")).alias("main"), "band", F.explode(F.array("a", "b")).alias("id"))
    near = near.union(near.select("main", "band", F.col("main").alias("id"))).distinct().withColumn("g", F.xxhash64("main", "band", F.lit(0)))
    # What is far from all hubs of its bucket: sets that still probe it ask the others. Buckets with the same members are one group.
    rest = buckets.join(sketch.groupBy("id").agg(F.max("n").alias("n")), "id").select("sig", "id", "probe", (F.length(F.bin("n")) - 1 + F.col("cross").cast("int")).alias("band"))
    alike = rest.groupBy("sig").agg(F.count("*").alias("n"), *[F.bit_xor(F.xxhash64("id", "probe", F.lit(i))).alias(f"x{i}") for i in (1, 2)]).groupBy("n", "x1", "x2").agg(F.min("sig").alias("sig"))
    rest = rest.join(alike.select("sig"), "sig").select(F.xxhash64("sig", F.lit(1)).alias("g"), "band", "id", F.col("probe").alias("asks"), F.lit(None).cast("long").alias("main"))
    together = cut(near.select("g", "band", "id", F.lit(True).alias("asks"), "main").union(rest), "jaccard-together")
    links.append(_group_links(together, union(links), sketch, reps, k, percent))
    label = components(union(links))
    forget(buckets, sketch, together, *judged, *links)
    sets_of = groups.select(*key, "set_id").join(label.select(F.col("id").alias("set_id"), "component"), "set_id", "left")
    sets_of = sets_of.withColumn("component", F.coalesce("component", "set_id"))
    out = meta.join(sets_of, key, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("set_id", "doc_id").alias("set_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the least doc_id. Of rows that share this doc_id one stays; rows without shingles link with nothing and all stay, as do rows with a null doc_id that equal no other."""
    found = jaccard_components(docs, k, percent)
    extra = found.where("n_shingles > 0 and component_id <> doc_id").select("doc_id").distinct()
    kept = without(docs, cut(extra, "jaccard-drop"))
    # A doc_id that occurs more than once is rare; only those rows are grouped, and of equal ones any stays.
    id_, place = own_name(docs, "twice"), own_name(docs, "place")
    twice = cut(found.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_)), "jaccard-twice")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice[id_], "left_anti")
    several = kept.join(twice, kept["doc_id"] == twice[id_], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns]), "text"))
    return once.unionByName(several.withColumn(place, first).where(F.col(place) == 1).drop(place))
