"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative.

Centres are fitted on a bounded sample drawn by hash; every vector is assigned to its
nearest, its home. Vectors of a home are dealt by hash into blocks of bounded size, one
row each, and blocks meet blocks in a product of block rows: nothing is shuffled for
it and no vector is written again, so disk grows as the table. Between two homes lies
their bisecting plane: vectors of either side cannot be closer than the sum of their
angles to it. Both sides are sorted by these, and only pairs whose sum is within the
angle of the threshold are multiplied, so every link is found.

A product is taken in single precision over the leading axes of the sample, the rest
of a vector counts with its length. That bounds the cosine from above; pairs that the
bound, less its rounding, leaves are decided in double precision over all components.

A task reports how many partners each linked vector has and one member of its
part; pairs are never listed. Equal vectors are one vector with a weight. Where the
vectors form no groups, planes spare a part of the pairs only, and time grows faster than the table.

Defined results: vectors that are null, zero, or hold null or non-finite
components link with nothing; vectors of different length do not link; rows
that repeat an id each give a row, are linked with each other if their vectors
are, and share a component; a null id links with nothing and has a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import NO_ID
from quern.llm.components import components
from quern.session import materialise

THRESHOLD = 0.9
SAMPLE = 16_384
PER_CELL = 4
CELL = 2048
BLOCK = 16_384
ROUNDS = 8

_BLOCK_BYTES = 1 << 23
_LEAST_BLOCKS = 32
"""A table has about as many blocks, so that many tasks share it, unless they would be smaller than 256."""
_TASK_BYTES = 1 << 25
"""Blocks of about so many bytes, as doubles, are one side of a task."""
_TILE = (128, 1024)
_HELD_LINKS = 1 << 19
_IDS = 1 << 14


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one. A power of two takes out their magnitude first, so no norm over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres; ``x`` holds unit rows."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        cell = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        norms = np.linalg.norm(sums, axis=1)
        full = norms > 1e-12
        centres[full] = sums[full] / norms[full, None]
    return centres


def leading_axes(x: np.ndarray, threshold: float) -> np.ndarray | None:
    """Columns: the axes of most weight in the unit rows ``x``, as many as make products cheapest; None for all components.

    Fewer axes are quicker, but leave more pairs to be decided; both are weighed on pairs of ``x``.
    """
    size, m = x.shape[1], min(1024, len(x) // 2)
    if m < 64:
        return None
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    a, b = x[:m] @ axes, x[m : 2 * m] @ axes
    far, like, best, least = a @ b.T < threshold, np.zeros((m, m)), None, 0.5 + 0.012 * size
    for p in range(7, size - 1, 8):
        at = slice(0 if p == 7 else p - 8, p)
        like += a[:, at] @ b[:, at].T
        rest = [np.linalg.norm(y[:, p:], axis=1) for y in (a, b)]
        left = (far & (like + rest[0][:, None] * rest[1] >= threshold)).mean()
        if (cost := 0.5 + 0.012 * (p + 1) + 1000 * left) < least:  # nanoseconds a pair, measured
            best, least = axes[:, :p].copy(), cost
    return best


def fit(vectors: DataFrame, threshold: float, sample: int = SAMPLE, per_cell: int | None = None) -> dict[int, tuple]:
    """Centres and leading axes for each vector length in a sample of ``vectors(id, v)``.

    A centre has ``per_cell`` vectors of the sample; by default about :data:`CELL` of the table, :data:`PER_CELL` at least.
    """
    mark, rows = F.xxhash64("id", "v"), vectors.count()
    share = 2 * sample / max(1, rows)
    near = vectors if share >= 1 else vectors.where(F.pmod(mark, F.lit(1 << 40)) < int(share * (1 << 40)))
    clean = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    drawn = near.where(F.col("v").isNotNull()).where(clean).where(F.col("id") != NO_ID).orderBy(mark, "id").limit(sample).select("v").toPandas()["v"]
    per_cell = per_cell or max(PER_CELL, -(-CELL * len(drawn) // max(1, rows)))
    by_size: dict[int, list[np.ndarray]] = {}
    for v in drawn:
        by_size.setdefault(len(v), []).append(np.asarray(v, float))
    out = {}
    for size, rows in by_size.items():
        x = _unit(np.array(rows))
        out[size] = spherical_kmeans(x, max(1, len(x) // per_cell)), leading_axes(x, threshold)
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal rows the first, and for each row which of these it is."""
    marks = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    return np.unique(marks, return_index=True, return_inverse=True)[1:]


def _packed(model: dict[int, tuple]):
    """A row for each distinct vector of a batch: its components as bytes, in single precision where that is exact, its home
    and its ids; and one row without bytes for the ids whose vectors link with nothing."""

    def homes(x: np.ndarray) -> np.ndarray:
        centres = model[x.shape[1]][0] if x.shape[1] in model else x[:1]
        return np.round(_unit(x) @ centres.T, 9).argmax(1)  # the same for equal vectors wherever they stand

    def rows(size: int, cell: np.ndarray, x: np.ndarray, ids: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        n, counts = len(x), np.bincount(which, minlength=len(x))
        ends = np.arange(n + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), ids[np.argsort(which, kind="stable")])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), pa.array(cell, pa.int32()), packed, lists], names=["size", "cell", "b", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, ids = batch.column("v"), batch.column("id")
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, starts = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            known = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            idle = np.ones(len(lengths), bool)
            for size in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero((lengths == size) & (known != NO_ID))
                x = values[starts[at][:, None] + np.arange(size)] + 0.0  # without -0.0
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                idle[at[good]] = False
                with np.errstate(over="ignore", under="ignore"):
                    narrow = (x.astype("<f4") == x).all(1)
                for kind, chosen in (("<f4", good & narrow), ("<f8", good & ~narrow)):
                    if chosen.any():
                        first, which = _distinct(y := x[chosen].astype(kind))
                        yield rows(size, homes(y[first].astype(float)), y[first], known[at[chosen]], which)
            if idle.any():
                none = ids.filter(pa.array(idle))
                lists = pa.ListArray.from_arrays(pa.array([0, len(none)], pa.int32()), none)
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), lists], names=["size", "cell", "b", "ids"])

    return run


def _numbered(counts: list[tuple[int, int, int]], block: int) -> list[tuple[int, int, int, int]]:
    """``(size, cell, first, parts)`` for each ``(size, cell, vectors)``: the blocks of a cell. Small cells share one."""
    total, out, number, free, last = sum(n for _, _, n in counts), [], 0, 0, None
    for size, cell, n in sorted(counts):
        room = max(1, min(block, max(256, -(-total // _LEAST_BLOCKS)), max(64, _BLOCK_BYTES // (8 * size))))
        if size == last and n <= free:
            out.append((size, cell, number - 1, 1))
            free -= n
            continue
        parts = -(-n // room)
        out.append((size, cell, number, parts))
        number, free, last = number + parts, room - n if parts == 1 else 0, size
    return out


_BLOCK_ROW = "no long, size int, wide boolean, vectors binary, weights binary, home binary, ids array<long>, at array<long>, alike array<long>, first array<long>"


def _name(no: int, at: np.ndarray) -> np.ndarray:
    """A vector's name: its block and its place there."""
    return (np.int64(no) << np.int64(24)) + at.astype(np.int64)


def _block():
    """One group: a block's vectors become a row, those of a home next to each other, and their ids as many as they need:
    a common vector has any number."""
    lists = [(c, pa.list_(pa.int64())) for c in ("ids", "at", "alike", "first")]
    schema = pa.schema([("no", pa.int64()), ("size", pa.int32()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("vectors", "weights", "home")), *lists])

    def run(table: pa.Table) -> pa.Table:
        no, size = table.column("no")[0].as_py(), table.column("size")[0].as_py()
        packed, ids = table.column("b").combine_chunks(), table.column("ids").combine_chunks()
        raw = [v.as_buffer() for v in packed]
        kinds = np.array([len(v) // size for v in raw])
        x = np.empty((len(raw), size))
        for kind in (4, 8):
            if (kinds == kind).any():
                x[kinds == kind] = np.frombuffer(b"".join(v for v, k in zip(raw, kinds, strict=True) if k == kind), f"<f{kind}").reshape(-1, size)
        wide = bool((kinds == 8).any())
        kept, which = _distinct(x)
        home = table.column("cell").to_numpy()[kept]
        order = np.argsort(home, kind="stable")
        x, home, n = x[kept[order]], home[order], len(kept)

        id_at = np.repeat(np.argsort(order)[which], ids.value_lengths().to_numpy())
        flat = ids.flatten().to_numpy()
        weight, first = np.bincount(id_at, minlength=n), np.full(n, NO_ID)
        np.minimum.at(first, id_at, flat)
        vectors = {"no": no, "size": size, "wide": wide, "vectors": x.astype("<f8" if wide else "<f4").tobytes(), "weights": weight.astype("<i8").tobytes(), "home": home.astype("<i4").tobytes()}
        names, alike, first = _name(no, id_at), weight[id_at] - 1, first[id_at]
        parts = [slice(k, k + _IDS) for k in range(0, len(flat), _IDS)]
        out = [pa.array([vectors[f.name], *[None] * len(parts)], f.type) for f in schema if f.name in vectors]
        out += [pa.array([None, *(y[k] for k in parts)], pa.list_(pa.int64())) for y in (flat, names, alike, first)]
        return pa.Table.from_arrays(out, schema=schema)

    return run


class _Ready:
    """A block as products need it."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, model: dict[int, tuple]) -> None:
        get = lambda name: batch.column(f"{side}_{name}")[row]
        self.no, size = get("no").as_py(), get("size").as_py()
        self.raw = np.frombuffer(get("vectors").as_buffer(), "<f8" if get("wide").as_py() else "<f4").reshape(-1, size)
        self.weight = np.frombuffer(get("weights").as_buffer(), "<i8").copy()
        home = np.frombuffer(get("home").as_buffer(), "<i4")
        self.cells, starts, self.cell = np.unique(home, return_index=True, return_inverse=True)
        self.places = [slice(x, y) for x, y in zip(starts, [*starts[1:], len(home)], strict=True)]
        self.centres, axes = model[size] if size in model else (None, None)
        self.own = np.zeros(len(home))
        self.head = np.empty((len(home), size if axes is None else axes.shape[1] + 1), np.float32)
        for at in self.pieces():
            x = self.unit(at)
            if self.centres is not None:
                self.own[at] = np.einsum("ij,ij->i", x, self.centres[home[at]])
            if axes is not None:
                x = x @ axes
                x = np.column_stack((x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0) + 1e-12)))
            self.head[at] = x

    def pieces(self) -> list[slice]:
        return [slice(at, at + 2048) for at in range(0, len(self.raw), 2048)]

    def unit(self, at: np.ndarray | slice) -> np.ndarray:
        return _unit(self.raw[at].astype(float))

    def sines(self, other: _Ready) -> np.ndarray | None:
        """A row for each cell of the other block: how far each vector is from the plane that bisects its home and that cell, less rounding."""
        if self.centres is None:
            return None
        there = self.centres[other.cells]
        apart = np.sqrt(np.maximum(2 - 2 * (there @ self.centres[self.cells].T), 0))
        out = np.empty((len(there), len(self.raw)))
        for at in self.pieces():
            near = apart[:, self.cell[at]]
            far = (self.own[at] - there @ self.unit(at).T) / np.maximum(near, 1e-3) - 3e-6
            out[:, at] = np.where(near > 1e-3, np.clip(far, 0, 1), 0)
        return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's part in a graph of the nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]


def _stars(links: list[tuple[np.ndarray, np.ndarray]], n: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same parts as the given ones: each node and the smallest of its part. Nodes are names, or 0 to n - 1."""
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in links)]) for k in (0, 1))
    if n:
        root = _roots(n, a, b)
        nodes = np.flatnonzero(root != np.arange(n))
        return nodes, root[nodes]
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    return nodes, nodes[_roots(len(nodes), at[: len(a)], at[len(a) :])]


def _stairs(u: np.ndarray, v: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns, those nearest to the plane first, and how many columns each tile of rows may link with."""
    rows, columns = np.argsort(u), np.argsort(v)
    spare = angle - np.arcsin(u[rows[:: _TILE[0]]])
    reach = np.searchsorted(v[columns], np.sin(np.clip(spare, 0, np.pi / 2)), side="right")
    return rows, columns, np.where(spare < 0, 0, reach)


def _links(a: _Ready, b: _Ready, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of the linked pairs, tile by tile; each pair of one block once."""
    angle = np.arccos(np.clip(threshold, -1, 1)) + 1e-5
    u, v = a.sines(b), b.sines(a) if a is not b else None
    for m, (cell, at) in enumerate(zip(a.cells, a.places, strict=True)):
        for n, (other, there) in enumerate(zip(b.cells, b.places, strict=True)):
            if a is b and n < m:
                continue
            if cell == other:
                rows, columns = np.arange(at.start, at.stop), np.arange(there.start, there.stop)
                reach = np.full(-(-len(rows) // _TILE[0]), len(columns))
            else:
                rows, columns, reach = _stairs(u[n, at], (u if a is b else v)[m, there], angle)
                if not reach[0]:
                    continue
                rows, columns = rows[: np.count_nonzero(reach) * _TILE[0]] + at.start, columns[: reach[0]] + there.start
            yield from _decided(a, b, rows, columns, reach, threshold, a is b and m == n)


def _decided(a: _Ready, b: _Ready, rows: np.ndarray, columns: np.ndarray, reach: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of some rows and columns, each tile of rows with as many columns as it reaches; of the ``same`` cell each pair once."""
    low = np.float32(threshold - (a.raw.shape[1] + 16) * 2.0**-23)  # more than single precision can be off
    left, right, held = a.head[rows], b.head[columns], np.empty(_TILE[0] * _TILE[1], np.float32)
    some, open_ = [], 0
    for r, width in zip(range(0, len(rows), _TILE[0]), reach.tolist(), strict=False):
        for c in range(r // _TILE[1] * _TILE[1] if same else 0, width, _TILE[1]):
            p, q = left[r : r + _TILE[0]], right[c : min(c + _TILE[1], width)]
            bound = np.matmul(p, q.T, out=held[: len(p) * len(q)].reshape(len(p), len(q)))
            at = np.flatnonzero(bound.max(axis=1) >= low)
            if not len(at):
                continue
            maybe = bound[at] >= low
            at += r
            if same and c < r + len(p):
                maybe &= at[:, None] < np.arange(c, c + len(q))
            i, j = np.divmod(np.flatnonzero(maybe), len(q))
            if len(i) > maybe.size // 16:
                i, j = np.nonzero((a.unit(rows[at]) @ b.unit(columns[c : c + len(q)]).T >= threshold) & maybe)
                yield rows[at[i]], columns[c + j]
                continue
            some.append((rows[at[i]], columns[c + j]))
            open_ += len(i)
            if open_ > _HELD_LINKS:
                yield _linked(a, b, some, threshold)
                some, open_ = [], 0
    if open_:
        yield _linked(a, b, some, threshold)


def _linked(a: _Ready, b: _Ready, some: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of some pairs that link."""
    i, j = (np.concatenate([x[k] for x in some]) for k in (0, 1))
    step = max(1, (1 << 19) // a.raw.shape[1])
    sure = np.concatenate([np.einsum("ij,ij->i", a.unit(i[k : k + step]), b.unit(j[k : k + step])) >= threshold for k in range(0, len(i), step)])
    return i[sure], j[sure]


_SIDE = ("no", "size", "wide", "vectors", "weights", "home")


def _products(model: dict[int, tuple], threshold: float):
    """``(id, partners, low)`` of the linked vectors of a task's block pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[str, dict[int, _Ready]] = {"a": {}, "b": {}}
        partners: dict[int, np.ndarray] = {}
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                for side, held in sides.items():
                    if batch.column(f"{side}_no")[row].is_valid:
                        block = _Ready(batch, row, side, model)
                        held[block.no] = next((x[block.no] for x in sides.values() if block.no in x), block)
        for a in sides["a"].values():
            for b in sides["b"].values():
                # one of the two tasks that have both blocks, about half of them each
                if a.raw.shape[1] != b.raw.shape[1] or a is not b and (a.no < b.no) == ((a.no + b.no) % 2 == 0):
                    continue
                parts, own, held = [], [], 0
                nodes = len(a.raw) + (len(b.raw) if a is not b else 0)
                for i, j in chain(_links(a, b, threshold), [(None, None)]):
                    if i is not None:
                        own.append((i, j))
                        held += len(i)
                    if own and (i is None or held > _HELD_LINKS):
                        i, j = (np.concatenate([x[k] for x in own]) for k in (0, 1))
                        for x, at, other in ((a, i, b.weight[j]), (b, j, a.weight[i])):
                            partners.setdefault(x.no, np.zeros(len(x.raw), np.int64))
                            partners[x.no] += np.bincount(at, weights=other, minlength=len(x.raw)).astype(np.int64)
                        parts = [_stars([*parts, (i, j + (nodes - len(b.raw)))], nodes)]
                        own, held = [], 0
                if parts:
                    names = np.concatenate((_name(a.no, np.arange(len(a.raw))), _name(b.no, np.arange(len(b.raw)))))
                    links.append(tuple(names[x] for x in parts[0]))
                    if sum(len(x) for x, _ in links) > 2 * _HELD_LINKS:
                        links = [_stars(links)]
        nodes, roots = _stars(links)
        for no, counts in partners.items():
            at = np.flatnonzero(counts)
            names = _name(no, at)
            low = roots[np.searchsorted(nodes, names)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts[at]), pa.array(low)], names=["id", "partners", "low"])

    return run


@contextmanager
def _small_batches(spark: SparkSession, setting: str = "spark.sql.execution.arrow.maxBytesPerBatch") -> Iterator[None]:
    """Rows that hold blocks go to the workers a few at a time."""
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, str(1 << 23))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, per_cell: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component)`` per row of ``vectors(id, v)``, ``v`` an array of double."""
    spark = vectors.sparkSession
    model = fit(vectors, threshold, sample, per_cell)
    placed = materialise(vectors.select("id", "v").mapInArrow(_packed(model), "size int, cell int, b binary, ids array<long>"))
    usable = placed.where("b is not null")

    counts = [tuple(x) for x in usable.groupBy("size", "cell").count().collect()]
    numbered = _numbered(counts, block)
    places = F.broadcast(spark.createDataFrame(numbered, "size int, cell int, first long, parts long"))
    dealt = usable.join(places, ["size", "cell"]).select((F.col("first") + F.pmod(F.xxhash64("b"), "parts")).alias("no"), "size", "cell", "b", "ids")
    blocks = materialise(dealt.groupBy("no").applyInArrow(_block(), _BLOCK_ROW))

    tasks = max(1, -(-sum(8 * size * n for size, _, n in counts) // _TASK_BYTES), int((4 * spark.sparkContext.defaultParallelism) ** 0.5))
    side = lambda s: blocks.where("vectors is not null").select(*(F.col(c).alias(f"{s}_{c}") for c in _SIDE)).coalesce(tasks).withColumn(f"{s}_lead", F.monotonically_increasing_id() % (1 << 33) == 0)
    # a task gets the rows of one part with those of another; each goes to its worker once, beside the first of the other part
    rows = side("a").join(side("b").hint("shuffle_replicate_nl"), F.expr("a_lead or b_lead"))
    sent = rows.select(*(F.when(F.col(f"{'ba'[s == 'b']}_lead"), F.col(f"{s}_{c}")).alias(f"{s}_{c}") for s in "ab" for c in _SIDE))
    with _small_batches(spark):
        found = materialise(sent.mapInArrow(_products(model, threshold), "id long, partners long, low long"))

    parts = components(found.select(F.col("id").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "id")
    linked = found.groupBy("id").agg(F.sum("partners").alias("partners")).join(parts, "id").withColumnsRenamed({"id": "at", "component": "part"})
    each = blocks.where("ids is not null").select(F.explode(F.arrays_zip("ids", "at", "alike", "first")).alias("x")).select(F.col("x.ids").alias("id"), "x.at", "x.alike", "x.first")
    rows = each.join(linked, "at", "left")
    lowest = rows.where("part is not null").groupBy("part").agg(F.min("first").alias("component"))
    rows = rows.join(lowest, "part", "left").select("id", (F.coalesce("partners", F.lit(0)) + F.col("alike")).alias("n_links"), F.coalesce("component", "first").alias("component"))
    idle = placed.where("b is null").select(F.explode("ids").alias("id"))
    idle = idle.select("id", F.lit(0).cast("long").alias("n_links"), F.when(F.col("id") != NO_ID, F.col("id")).alias("component"))
    return _one_component_per_id(rows.union(idle))


def _one_component_per_id(rows: DataFrame) -> DataFrame:
    """Rows of one id share a component; changes nothing where ids are unique."""
    rows = materialise(rows)
    mixed = rows.groupBy("id").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    if mixed.isEmpty():
        return rows
    joins = rows.join(mixed.select("id"), "id").select(F.col("component").alias("a"), F.col("id").alias("b"))
    more = components(joins.union(rows.where(F.col("id") != NO_ID).select(F.col("component").alias("a"), F.col("id").alias("b")))).withColumnRenamed("node", "id")
    return rows.join(more.withColumnRenamed("component", "merged"), "id", "left").select("id", "n_links", F.coalesce("merged", "component").alias("component"))


def vector_report(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    key = F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID))
    done = near_duplicates(embeddings.select(key.alias("id"), F.col("embedding").cast("array<double>").alias("v")))
    vec = F.when(F.col("id") != NO_ID, F.col("id"))
    return done.select(vec.alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(vec == F.col("component"), F.lit(False)).alias("kept"))
