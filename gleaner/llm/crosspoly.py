"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, several probes.

A rotation is three rounds of random signs and a Hadamard transform; a vector's code is
its largest coordinate with its sign. K codes make a bucket of a table. Besides its own
bucket a vector asks those in which one code is its second largest coordinate instead.
Bucket mates are compared in double precision, in blocks, and each pair counts only where
the two first meet, so that counts need no list of pairs.

Equal vectors are one class, compared once. The number of codes K follows from the number
of classes, the number of tables from K and from how often two random vectors at the
threshold's angle share a bucket: so many that a pair is missed less than once in 10,000.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import components
from gleaner.session import settle

MISS = 1e-4
BLOCK = 1024
TRIALS = 4000
FOUND = "cid long, links long, other long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows transformed by the Walsh-Hadamard matrix; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def codes(unit: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest and second largest coordinates, with sign, under each rotation: rows x rotations."""
    n, d = unit.shape
    wide = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = unit
    first, second = np.empty((n, rotations), np.int32), np.empty((n, rotations), np.int32)
    rows = np.arange(n)
    for r in range(rotations):
        signs = np.random.default_rng([wide, r]).choice((-1.0, 1.0), (3, wide))
        x = padded
        for s in signs:
            x = hadamard(x * s)
        size = np.abs(x)
        for out in (first, second):
            at = size.argmax(axis=1)
            out[:, r] = 2 * at + (x[rows, at] < 0)
            size[rows, at] = -1
    return first, second


def meeting(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether pairs meet, by table and kind: same bucket, a asks for b's bucket, b for a's. Codes: pairs x tables x K."""
    same = a[0] == b[0]
    k = same.shape[2]
    out = np.empty((*same.shape[:2], 3), bool)
    out[:, :, 0] = same.all(axis=2)
    for kind, (one, two) in ((1, (a, b)), (2, (b, a))):
        other = one[1] == two[0]
        out[:, :, kind] = ((same.sum(axis=2) == k - 1) & (other & ~same).any(axis=2))
    return out


def shape(classes: int, dims: int, cosine: float) -> tuple[int, int]:
    """Codes in a bucket, and tables."""
    wide = 1 << max(1, (dims - 1).bit_length())
    k = max(1, round(math.log(max(2, classes)) / math.log(2 * wide)))
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(2, TRIALS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = cosine * x + math.sqrt(1 - cosine**2) * y
    a, b = (tuple(c.reshape(TRIALS, 1, k) for c in codes(v, k)) for v in (x, y))
    met = min(0.999, max(1e-3, meeting(a, b).any(axis=(1, 2)).mean()))
    return k, max(2, math.ceil(math.log(MISS) / math.log(1 - met)))


def units(batch) -> np.ndarray:
    flat = np.array(batch.column("embedding").to_pylist(), np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # huge and tiny components stay in range
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def keyed(k: int, tables: int, dims: int):
    """Rows (key, stored, cid) for a vector's own buckets and those it asks."""

    def run(batches):
        import pyarrow as pa

        base = np.int64(2 * (1 << max(1, (dims - 1).bit_length())))
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                first, second = (c.reshape(-1, tables, k).astype(np.int64) for c in codes(units(batch), tables * k))
                n = len(first)
                keys = []
                for change in range(-1, k):
                    own = first.copy()
                    if change >= 0:
                        own[:, :, change] = second[:, :, change]
                    key = np.broadcast_to(np.arange(tables, dtype=np.int64), (n, tables)).copy()
                    for i in range(k):
                        key = key * base + own[:, :, i]
                    keys.append(key)
                keys = np.stack(keys, axis=2).reshape(n, -1)
                per = keys.shape[1]
                stored = np.tile(np.arange(per) % (k + 1) == 0, n)
                cid = np.repeat(batch.column("cid").to_numpy(), per)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(stored), pa.array(cid)], names=["key", "stored", "cid"])

    return run


def compared(k: int, tables: int, dims: int, cosine: float):
    """Over rows sorted by (key, s, q): links of asking with stored rows, where the pair first meets.

    The groups of a batch are worked on together, some ten thousand pairs at a time; the
    last group of a batch waits for the next one.
    """

    def run(batches):
        import pyarrow as pa

        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = groups(rows)
            last = int(np.searchsorted(group, group[-1])) if len(group) else 0
            rest = rows.slice(last)
            if last:
                yield from worked(rows.slice(0, last), group[:last])
        if rest is not None and rest.num_rows:
            yield from worked(rest, groups(rest))

    def groups(rows) -> np.ndarray:
        key, s, q = (rows.column(c).to_numpy() for c in ("key", "s", "q"))
        new = (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (q[1:] != q[:-1])
        return np.concatenate([[0], np.cumsum(new)]) if len(key) else np.zeros(0, np.int64)

    def worked(rows, group):
        import pyarrow as pa

        unit, first, second = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t).reshape(len(group), *n) for c, t, n in (("unit", np.float64, (dims,)), ("best", np.int32, (tables, k)), ("next", np.int32, (tables, k))))
        cid, size, role, table = (rows.column(c).to_numpy() for c in ("cid", "size", "role", "tab"))
        own = rows.column("stored").to_numpy(zero_copy_only=False)
        ask, kept = np.flatnonzero(role & 2), np.flatnonzero(role & 1)
        begin, end = np.searchsorted(group[kept], group[ask]), np.searchsorted(group[kept], group[ask], side="right")
        upto = np.cumsum(end - begin)
        links, xs, ys = np.zeros(len(group), np.int64), [], []
        at = 0
        while at < len(ask):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 50_000)))
            n = end[at:stop] - begin[at:stop]
            x = np.repeat(ask[at:stop], n)
            y = kept[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:stop], n)]
            at = stop
            good = (cid[x] != cid[y]) & (~own[x] | (cid[x] < cid[y]))  # two stored rows meet twice: one way counts
            x, y = x[good], y[good]
            close = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            x, y = x[close], y[close]
            small, large = np.where(cid[x] < cid[y], x, y), np.where(cid[x] < cid[y], y, x)
            kind = np.where(own[x], 0, np.where(cid[x] < cid[y], 1, 2))
            met = meeting((first[small], second[small]), (first[large], second[large])).reshape(len(x), 3 * tables)
            new = met.argmax(axis=1) == 3 * table[x] + kind
            x, y = x[new], y[new]
            np.add.at(links, x, size[y])
            np.add.at(links, y, size[x])
            xs.append(x)
            ys.append(y)
        x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
        other = cid[spread(np.arange(len(group)), x, y)]
        out = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays([pa.array(cid[out]), pa.array(links[out]), pa.array(other[out])], names=["cid", "links", "other"])

    return run


def spread(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least row number of each row's component under the links x - y."""
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def coded(k: int, tables: int):
    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                unit = units(batch)
                first, second = codes(unit, tables * k)
                columns = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (unit, first, second)]
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("size"), *columns], names=["cid", "size", "unit", "best", "next"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors`` (vec_id, embedding, any others).

    Linked: cosine in double precision of ``cosine`` or more; vectors of different lengths
    are not. Vectors that are null, empty or zero, or have null or non-finite components,
    link with nothing. n_links counts other rows, copies included. Rows without vec_id
    have no component and are kept, but count as links of others.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    fine = F.coalesce((F.size("embedding") > 0) & fine, F.lit(False))
    classes = rows.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    lengths = [(r.dims, r["count"]) for r in classes.groupBy(F.size("embedding").alias("dims")).count().collect()]
    found = spark.createDataFrame([], FOUND)
    for dims, n in sorted(lengths):
        k, tables = shape(n, dims, cosine)
        own = classes.where(F.size("embedding") == dims)
        buckets = settle(own.select("cid", "embedding").mapInArrow(keyed(k, tables, dims), "key long, stored boolean, cid long"), "vec-keys")
        # Buckets in which nothing is stored, or only one row stands, have no pairs.
        used = buckets.groupBy("key").agg(F.count("*").alias("n"), F.max("stored").alias("any")).where("any AND n > 1").select("key", "n")
        buckets = buckets.join(settle(used, "vec-used"), "key")
        parts = F.ceil(F.col("n") / BLOCK).cast("int")
        buckets = buckets.withColumn("c", F.pmod(F.hash("cid"), parts)).withColumn("all", F.sequence(F.lit(0), parts - 1))
        place = lambda s, q, role: F.struct(s.cast("int").alias("s"), q.cast("int").alias("q"), role.alias("role"))
        asks = F.transform("all", lambda i: place(i, F.col("c"), F.when(F.col("stored") & (i == F.col("c")), 3).otherwise(2)))
        kept = F.when(F.col("stored"), F.transform(F.filter("all", lambda i: i != F.col("c")), lambda i: place(F.col("c"), i, F.lit(1)))).otherwise(F.array().cast("array<struct<s:int,q:int,role:int>>"))
        dealt = buckets.withColumn("place", F.explode(F.concat(asks, kept))).select("key", "stored", "cid", "place.*")
        base = (2 * (1 << max(1, (dims - 1).bit_length()))) ** k
        vecs = settle(own.select("cid", "size", "embedding").mapInArrow(coded(k, tables), "cid long, size long, unit binary, best binary, next binary"), "vec-codes")
        dealt = dealt.join(vecs, "cid").withColumn("tab", F.floor(F.col("key") / F.lit(base)).cast("int"))
        dealt = dealt.repartition("key", "s", "q").sortWithinPartitions("key", "s", "q")
        found = found.unionByName(dealt.mapInArrow(compared(k, tables, dims, cosine), FOUND))
    found = settle(found, "vec-found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    group = components(found.where("cid != other").select("cid", "other").distinct(), "cid", "other", "vec")
    named = classes.select("cid", "rep", "size", "embedding").join(links, "cid", "left").join(group.withColumnRenamed("node", "cid"), "cid", "left")
    named = settle(named.withColumn("component", F.coalesce("component", "cid")), "vec-named")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    named = settle(named, "vec-classes-done")
    good = rows.where(fine).join(named, "embedding").select("vec_id", F.col("links").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.col("least")).alias("component_id"))
    rest = rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
