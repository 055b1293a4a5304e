"""N-gram Jaccard self-join by T-occurrence search.

A text's words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) give the set of its
``size``-word shingles; a shorter text gives its whole sequence as one. Two
documents link when ``100 * intersection >= percent * union``.

An inverted list holds the documents of one shingle. Two sets of n and m
shingles link only if they share T = ceil(percent * (n + m) / (100 + percent))
of them, so a document may miss ``n - ceil(percent * n / 100)`` of its lists.

1. Identical sets are one class; from here on a class is its smallest id.
2. The longest lists are counted over all documents (`long_lists`; its size is
   a parameter). They come last in the order of lists, so they are merged only
   for documents made of little else. The order changes cost, never results.
3. The short lists of every document, one more than it may miss, are merged by
   one sort over (shingle, id). Lists of one document end there.
4. Each document of a list is checked against the list's first; confirmed links
   give components. Lists whose documents are still apart go through one more
   such pass, against the document nearest to the middle. What is apart after it
   is paired, where the list stands early enough on both sides for T
   to be reached. A document that a pass checked against its whole list leaves it.
5. Pairs are judged by signs first: the parity of the shingles in each of some
   cells. Two signs differ in at most as many cells as shingles stand in one set
   only, so no pair that links is lost. For step 4's last pairs signs stand in
   the rows of the lists, so what travels grows with the rows, not with the pairs.
6. A kept pair is settled by probing: binary search of one set in the other,
   block by block. Pairs inside one component are never formed.

Defined results: null and empty texts (or texts of white space) have an empty
set and link with nothing; rows that repeat an id are one document, linked by
what any of them links; a null id links with nothing and has a null component;
an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import NO_ID, by_batch, identified, public_id, raw_texts
from quern.llm.components import components
from quern.llm.hashing import found_in, grams, mix, spans, word_hashes
from quern.session import materialise

SIZE = 5
PERCENT = 80
LONG_LISTS = 200_000
_OFTEN = 3
_COUNTED = 1 << 21
_BLOCK = 256
_PASSES = 1
_SENT_IDS = 1 << 18
_PIVOT = {"id": "", "n": "_n", "place": "_place", "part": "_part"}


def shingles(raw: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(raw, lower=True)
    if 0 < len(words) < size:
        return spans(words, np.array([0]), np.array([len(words)]))
    return np.unique(grams(words, size))


def allowed(n: np.ndarray | int, percent: int):
    """Shingles that a linked partner of a set of n must share at least."""
    return -(-percent * n // 100)


def _often(size: int):
    """Shingles that stand in several documents of one stretch of rows, with how many."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
            held.clear()
            seen.clear()
            many = counts >= _OFTEN
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], schema=schema)

        total = 0
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                own = shingles(raw, size)
                mark = hash(own.tobytes())
                if mark in seen:  # copies of a set count once here
                    continue
                seen.add(mark)
                held.append(own)
                total += len(own)
                if total >= _COUNTED:
                    yield flush()
                    total = 0
        yield flush()

    return run


def long_lists(docs: DataFrame, size: int = SIZE, keep: int = LONG_LISTS) -> np.ndarray:
    """The shingles of the longest lists, longest last; at most ``keep`` of them."""
    counts = docs.mapInArrow(_often(size), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(keep).toPandas()
    return top["shingle"].to_numpy(dtype=np.int64)[::-1].view(np.uint64)


def sign(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls into each of some cells, one per shingle at least; 64 cells a word."""
    cells = max(64, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def _short_lists(size: int, percent: int, long_ones: np.ndarray, signed: bool = False):
    fields = [("id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("lists", pa.list_(pa.int64()))]
    schema = pa.schema(fields + [("sign", pa.list_(pa.int64()))] * signed)
    by_value = np.argsort(long_ones)
    table = long_ones[by_value]

    def run(batch: pa.RecordBatch) -> dict:
        n, c1, c2, signs, sizes, values = [], [], [], [], [0], [np.zeros(0, np.uint64)]
        for raw in raw_texts(batch.column("text")):
            own = shingles(raw, size)
            is_long = found_in(own, table)
            order = own[~is_long]
            need = len(own) - allowed(len(own), percent) + 1 if len(own) else 0
            if len(order) < need:
                late = own[is_long]
                order = np.concatenate((order, late[np.argsort(by_value[np.searchsorted(table, late)])]))
            n.append(len(own))
            c1.append(int(np.bitwise_xor.reduce(mix(own + np.uint64(1)))) if len(own) else 0)
            c2.append(int(mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(own) else 0)
            signs.append(sign(own) if signed else ())
            values.append(order[:need])
            sizes.append(len(order[:need]))
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
        return {"id": batch.column("id"), "n": n, "c1": as_long(c1), "c2": as_long(c2), "lists": lists, "sign": signs}

    return by_batch(run, schema)


def _merged_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shingle, id): keep lists of two or more, with the list's first document."""
    last = None  # the row that waits for its follower
    head = None  # first document of the open list: (id, n)
    open_list = False
    names = ["shingle", "id", "n", "place", "hub", "hub_n"]
    for batch in batches:
        s, i, n, place = (batch.column(c).to_numpy() for c in names[:4])
        if last is not None:
            s, i, n, place = (np.concatenate((np.array([v], c.dtype), c)) for v, c in zip(last, (s, i, n, place)))
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if open_list:  # the waiting row has its list's beginning in an earlier batch
            new[0] = False
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
        hub, hub_n = i[np.maximum(start, 0)], n[np.maximum(start, 0)]
        if head is not None:
            hub, hub_n = np.where(start < 0, head[0], hub), np.where(start < 0, head[1], hub_n)
        shared = ~new
        shared[:-1] |= ~new[1:]
        last, open_list, head = (s[-1], i[-1], n[-1], place[-1]), not new[-1], (hub[-1], hub_n[-1])
        keep = np.flatnonzero(shared[:-1])
        if len(keep):
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (s, i, n, place, hub, hub_n)], names=names)
    if last is not None and open_list:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*last, *head), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=names)


def _probe(size: int, percent: int):
    """Blocks arrive as the hub's text, then its partners'; each partner is probed in the hub's set."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, sets = None, []
        for batch in batches:
            a, b = [], []
            hubs, ids = batch.column("hub").to_pylist(), batch.column("id").to_pylist()
            for h, salt, i, raw in zip(hubs, batch.column("salt").to_pylist(), ids, raw_texts(batch.column("text"))):
                if hub != (h, salt):
                    hub, sets = (h, salt), []
                own = shingles(raw, size)
                if h == i:
                    sets.append(own)
                    continue
                for other in sets:
                    common = int(found_in(own, other).sum())
                    if common and 100 * common >= percent * (len(own) + len(other) - common):
                        a.append(h)
                        b.append(i)
                        break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return run


def _wanted(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts whose ids stand in ``rows``: ids are sent to them where they are few enough, else both are shuffled."""
    ids = rows.select("id").distinct()
    return texts.join(F.broadcast(ids) if ids.count() <= _SENT_IDS else ids, "id", "left_semi")


def near_enough(pairs: DataFrame, signs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(hub, id)`` whose signs leave room for T shared shingles: no pair that links is lost."""
    pairs = materialise(pairs)
    own = _with_rows(signs, pairs).select("hub", "id", "n", "sign")
    hubs = _wanted(signs, pairs.select(F.col("hub").alias("id")))
    hubs = hubs.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("sign").alias("hub_sign"))
    return own.join(hubs, "hub").where(_signs_meet(percent)).select("hub", "id").distinct()


def _signs_meet(percent: int) -> Column:
    """Whether two sets can still share T shingles.

    A cell in which their signs differ holds at least one shingle that stands in one of them only, and
    sets of n and m that link have at most ``n + m - 2 * T`` of these. The longer sign is folded to the shorter.
    """
    words = F.least(F.size("sign"), F.size("hub_sign"))
    differ = F.zip_with(_folded("sign", words), _folded("hub_sign", words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    n = F.col("n") + F.col("hub_n")
    return F.aggregate(differ, F.lit(0), lambda total, x: total + x) <= n - 2 * F.ceil(percent * n / F.lit(100 + percent))


def _folded(sign: str, words: Column) -> Column:
    """The sign over fewer cells: the parts of it, laid upon one another."""
    parts = F.sequence(F.lit(1), F.size(sign), words)
    none = F.array_repeat(F.lit(0).cast("long"), words)
    laid = F.aggregate(parts, none, lambda over, at: F.zip_with(over, F.slice(sign, at, words), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(sign) == words, F.col(sign)).otherwise(laid)


def sharing(pairs: DataFrame, listed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(hub, id)`` that share enough of their short lists to reach T, for tables without signs.

    Occurrences are counted, one side's lists against the other's: of their n - allowed + 1
    short lists, two sets that link share at least ``T - (larger of the two allowed) + 1``. Lists travel as
    16 bits of their hash; how many of a set's own fall together is added to the
    count, so no pair is lost. Few pairs are sent to the lists, so that only one side's are shuffled.
    """
    pairs = materialise(pairs)
    own = _with_rows(listed, pairs).select("hub", "id", "n", F.size("lists").alias("size"), _marks("lists").alias("marks"))
    hubs = _wanted(listed, pairs.select(F.col("hub").alias("id")))
    hubs = hubs.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), _marks("lists").alias("hub_marks"))
    common = F.size(F.array_intersect("marks", "hub_marks")) + F.col("size") - F.size("marks")
    met = own.join(hubs, "hub").where(common >= _least(percent, F.col("n"), F.col("hub_n")))
    return met.select("hub", "id").distinct()


def _marks(lists: str) -> Column:
    return F.array_distinct(F.transform(lists, lambda x: F.shiftright(F.shiftleft(x, 16), 48).cast("short")))


def _with_rows(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Each of ``rows`` with the text of its id: few rows are sent to the texts, which then stay where they are."""
    if rows.count() <= _SENT_IDS:
        return texts.join(F.broadcast(rows), "id")
    return _wanted(texts, rows).join(rows, "id")


def _least(percent: int, n: Column, m: Column) -> Column:
    """Short lists that sets of n and m share at least where they link."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent)) - F.greatest(F.ceil(percent * n / 100), F.ceil(percent * m / 100)) + 1


def probed(pairs: DataFrame, texts: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(hub, id)`` whose texts link, as ``(a, b)``. A hub with many partners is salted."""
    pairs = materialise(pairs)
    counts = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    counts = counts.select("hub", F.ceil(F.col("n") / _BLOCK).cast("int").alias("blocks"))
    salted = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("salt"), "id", F.lit(1).alias("turn"))
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"), F.col("hub").alias("id"), F.lit(0).alias("turn"))
    rows = _with_rows(texts, materialise(salted.union(hubs))).select("hub", "salt", "turn", "id", "text")
    blocks = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "turn")
    return blocks.mapInArrow(_probe(size, percent), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, keep_long: int = LONG_LISTS) -> DataFrame:
    """``(id, n, component)`` per row of ``docs(id, text)``."""
    long_ones = long_lists(docs.where(F.col("id") != NO_ID), size, keep_long)
    columns = "id long, n long, c1 long, c2 long, lists array<long>, sign array<long>"
    own = materialise(docs.mapInArrow(_short_lists(size, percent, long_ones, signed=True), columns))

    sets = own.where((F.col("n") > 0) & (F.col("id") != NO_ID))
    classes = sets.groupBy("n", "c1", "c2").agg(F.min("id").alias("first"), F.any_value("lists").alias("lists"), F.any_value("sign").alias("sign"))
    groups = sets.groupBy("n", "c1", "c2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = sets.join(groups, ["n", "c1", "c2"]).where("id > first")
    copies = materialise(copies.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct())

    listed = materialise(classes.select(F.col("first").alias("id"), "n", "lists", "sign"))
    postings = listed.select(F.posexplode("lists").alias("place", "shingle"), "id", "n").repartition("shingle").sortWithinPartitions("shingle", "id")
    lists = materialise(postings.mapInArrow(_merged_lists, "shingle long, id long, n long, place int, hub long, hub_n long"))

    texts, signs = docs.where(F.col("id") != NO_ID).select("id", "text"), listed.select("id", "n", "sign")

    def settled(pairs: DataFrame) -> DataFrame:
        return materialise(probed(near_enough(pairs, signs, percent), texts, size, percent))

    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    links = settled(lists.where((F.col("id") != F.col("hub")) & near).select("hub", "id").distinct())
    parts = components(links)

    apart = _with_parts(lists.where(F.col("id") != F.col("hub")).select("shingle", "id", "n", "place"), parts)
    for _ in range(_PASSES):
        apart = materialise(_with_pivots(apart))
        reached = apart.where(_can_reach(percent, "pivot")).select(F.col("pivot").alias("hub"), "id").distinct()
        more = settled(reached)
        apart = apart.where(F.col("id") != F.col("pivot")).select("shingle", "id", "n", "place", "part")
        if more.isEmpty():
            break
        links = parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
        parts = components(links)
        apart = _with_parts(apart.drop("part"), parts)
    more = settled(_reaching_pairs(_with_signs(materialise(_mixed(apart)), signs), percent))

    found = components(links.union(more).union(copies))
    return _with_components(own, found)


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    found = rows.join(parts.withColumnRenamed("node", "id"), "id", "left")
    return found.withColumn("part", F.coalesce("component", "id")).drop("component")


def _mixed(apart: DataFrame) -> DataFrame:
    """Rows of lists whose documents are in more than one part."""
    mixed = apart.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    return apart.join(mixed.where("low < high").select("shingle"), "shingle")


def _with_pivots(apart: DataFrame) -> DataFrame:
    """Rows of mixed lists with one document of the list to check against.

    It is the one with the smallest share of its lists before this one: few
    rare shingles of its own, so it is near the middle of a group of copies.
    """
    early = F.struct((F.col("place") / F.col("n")).alias("early"), "id", "n", "place", "part")
    lists = apart.groupBy("shingle").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min(early).alias("p"))
    lists = lists.where("low < high").select("shingle", *(F.col(f"p.{c}").alias(f"pivot{t}") for c, t in _PIVOT.items()))
    return apart.join(lists, "shingle")


def _can_reach(percent: int, other: str) -> Column:
    """Whether a row and another of its list, of another part, can still reach T.

    Of n - allowed + 1 short lists each, a linked pair shares at least
    ``T - (larger of the two allowed) + 1``. The first list they share has all
    the others behind it, so it stands that far from the end on both sides.
    """
    n, m = F.col("n"), F.col(f"{other}_n")
    own, its = F.ceil(percent * n / 100), F.ceil(percent * m / 100)
    least = _least(percent, n, m)
    far = (F.col("place") <= n - own + 1 - least) & (F.col(f"{other}_place") <= m - its + 1 - least)
    return (F.col(f"{other}_part") != F.col("part")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & far


def _with_signs(apart: DataFrame, signs: DataFrame) -> DataFrame:
    """Rows of lists with their documents' signs, folded once to half a cell per shingle at least."""
    half = F.greatest(F.lit(1), F.floor(F.size("sign") / 2)).cast("int")
    rows = _with_rows(signs, apart.drop("n"))
    return materialise(rows.select(*apart.columns, _folded("sign", half).alias("sign")))


def _reaching_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """Pairs from different parts that can still reach T. Signs travel with the lists' rows, so that pairs are judged where they meet."""
    left = apart.select("shingle", *(F.col(c).alias(f"hub{t}") for c, t in _PIVOT.items()), F.col("sign").alias("hub_sign"))
    both = (left["shingle"] == apart["shingle"]) & (F.col("hub_part") < F.col("part")) & _can_reach(percent, "hub") & _signs_meet(percent)
    return left.join(apart, both).select("hub", "id").distinct()


def _with_components(own: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("node", "id")
    whole = F.when(F.col("id") != NO_ID, F.coalesce("component", "id"))
    return own.select("id", "n").join(found, "id", "left").select("id", "n", whole.alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without those that link, over any links, to a smaller id; all columns stay."""
    done = jaccard_components(identified(docs))
    later = done.where("component < id").select(F.col("id").alias("__later_id")).distinct()
    return docs.join(later, docs["doc_id"].cast("long") == F.col("__later_id"), "left_anti")


def jaccard_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row."""
    done = jaccard_components(identified(docs))
    return done.select(public_id().alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
