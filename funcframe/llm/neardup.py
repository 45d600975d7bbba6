"""MinHash near-duplicates by tensored banding: table keys pair up from two small collections, links are confirmed.

A document has ``N_A`` keys of three minhashes and ``N_B`` keys of two; each pair (a, b) is the key of a table. So 46
minhashes give 80 tables of five each, where 80 separate bands would take 400. A pair of similarity s misses all tables
with a chance of at most (1 - s**3)**10 + (1 - s**2)**8: 0.1 % at 0.8, 0.01 % at 0.85. Candidates are confirmed on the
full shingle sets, a 64-bit hash for each shingle.

Documents with equal sets, by a digest of the whole set, are one class from the start. In a bucket of a table, classes are compared with its least
class. Of small buckets that then hold more than one component, all pairs of different components are compared; in large
ones, those that share one of their sets' rarest shingles (similar sets do, so this loses no pair) and whose sizes, places
of the first common shingle and parities of 1024 bits allow the similarity. Both tests are exact bounds, and the second
leaves few pairs below the similarity. So large groups of copies cost about one comparison a copy, pairs grow with the links
between components, and no candidate is left out.

Defined cases. A text without words, or null, has an empty set and is linked with nothing. Fewer words than the shingle's
width make one shingle. Rows without an id are linked with nothing and kept. Rows that share an id are one document with
all its rows' sets. Ties go to the smaller id. An empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from funcframe.llm.bytesof import mix64, words_of
from funcframe.llm.common import fresh, map_texts, materialise, table

PERCENT = 80
N_A, ROWS_A = 10, 3
N_B, ROWS_B = 8, 2
N_HASHES = N_A * ROWS_A + N_B * ROWS_B
#: Ids of at most so many rows (16 MB) are sent to all executors; more are joined by a shuffle.
SENT_IDS = 1_000_000
#: At most so many links are joined by one task; more are contracted by shuffles first.
LINKS_AT_ONCE = 500_000
#: In open buckets of at most so many classes all pairs are candidates; those of larger ones have to share a rare shingle.
SMALL = 16
#: Rows of a large bucket that one task compares with those that lead it.
CELL = 2048
#: Bits of the parity of a set.
BITS = 1024
#: A key of more rows than this, and than one in ``HOT_KEYS`` of all, is cut into cells; so at most ``HOT_KEYS`` keys are.
HOT_ROWS, HOT_KEYS = 512, 100_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: list[bytes | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words, with A-Z in lower case."""
    w = words_of(raw)
    h = w.hashes(lower=True)
    out = []
    ends = np.cumsum(w.counts)
    n = len(h)
    s = h.copy()
    for k in range(1, width):
        s[: n - k] = mix64(s[: n - k] * _ODD + h[k:]) if n > k else s[: n - k]
    for a, b in zip(ends - w.counts, ends, strict=True):
        if b - a >= width:
            out.append(np.unique(s[a : b - width + 1]))
        elif b > a:
            one = mix64(np.array([b - a], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            for i in range(a, b):
                one = mix64(one * _ODD + h[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, N_HASHES); rows of empty sets are of no use."""
    out = np.zeros((len(sets), N_HASHES), dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    seeds = mix64(np.arange(1, 2 * N_HASHES + 1, dtype=np.uint64) * _ODD)
    step = 1 << 17
    at = 0
    while at < len(full):  # so many elements at a time as stay in a processor's cache
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[full[at:]]), step)))
        rows = full[at:upto]
        x = np.concatenate([sets[i] for i in rows])
        first = np.cumsum(sizes[rows]) - sizes[rows]
        for k in range(N_HASHES):
            out[rows, k] = np.minimum.reduceat((x ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1)), first)
        at = upto
    return out


def _folded(m: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """A 64-bit key of each run of ``rows`` minhashes and its number."""
    parts = m.reshape(len(m), groups, rows)
    key = np.broadcast_to(mix64(np.arange(1, groups + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), parts.shape[:2]).copy()
    for k in range(rows):
        key = mix64(key * _ODD + parts[:, :, k])
    return key.view(np.int64)


def _prints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Half of the SHA-256 of each whole sorted set, as two numbers: sets that agree in them are equal."""
    digests = b"".join(hashlib.sha256(s.astype("<u8")).digest()[:16] for s in sets)
    one, two = np.frombuffer(digests, dtype="<i8").reshape(len(sets), 2).T
    return one, two


def _lists(keys: np.ndarray) -> pa.Array:
    n, k = keys.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(keys.ravel()))


def signatures(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n (the set's size), two prints of the set, and the two collections of keys."""

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        sets = shingles(raw, width)
        m = minhashes(sets)
        f1, f2 = _prints(sets)
        cut = N_A * ROWS_A
        return {"n": [len(s) for s in sets], "f1": f1, "f2": f2, "a": _lists(_folded(m[:, :cut], N_A, ROWS_A)), "b": _lists(_folded(m[:, cut:], N_B, ROWS_B))}

    return map_texts(documents.select("doc_id", "text"), "text", ["doc_id"], work, "n long, f1 long, f2 long, a array<long>, b array<long>")


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, id): the classes in every table; the key tells the table, too."""
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    return classes.select(F.explode(pairs).alias("key"), F.col("rep").alias("id"))


def members(classes: DataFrame) -> DataFrame:
    """(key, centre, centre_n, id, n) of the buckets with two classes or more, one bucket for each set of classes.

    A bucket is summed up before the shuffle, as its least class and the exclusive or of hashes of all its classes, which
    also tell it from one with other classes. The join back can be split where a bucket is large.
    """
    keys = table_keys(classes)
    full = keys.groupBy("key").agg(F.min("id").alias("centre"), F.bit_xor(F.xxhash64("id")).alias("mark")).where(F.col("mark") != F.xxhash64("centre"))
    once = materialise(full.groupBy("centre", "mark").agg(F.min("key").alias("key")), "buckets")
    sizes = classes.select(F.col("rep").alias("id"), "n")
    held = materialise(keys.join(once.select("key", "centre").hint("merge"), "key"), "members")
    held = held.join(sizes.hint("merge"), "id").select("key", "centre", "id", "n")
    return materialise(held.join(sizes.select(F.col("id").alias("centre"), F.col("n").alias("centre_n")).hint("merge"), "centre"), "members")


def _may_link(n_a: str, room_a: str, n_b: str, room_b: str) -> Column:
    """Whether sets of sizes ``n`` can be similar whose first common element leaves each ``room`` (itself included).

    With all their elements as room this is what the sizes alone allow.
    """
    return (100 + PERCENT) * F.least(room_a, room_b) >= PERCENT * (F.col(n_a) + F.col(n_b))


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BITS / 64): each element flips one of ``BITS`` bits, so sets differ in no fewer elements than bits."""
    out = np.zeros((len(sets), BITS), dtype=np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount((mix64(s) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(out, axis=1).view(np.int64)


def _near_bits(n_a: str, bits_a: str, n_b: str, bits_b: str) -> Column:
    """Whether the parities of sets of sizes ``n`` differ in no more bits than similar sets differ in elements."""
    differ = sum((F.bit_count(F.col(bits_a)[i].bitwiseXOR(F.col(bits_b)[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 + PERCENT) * differ <= (100 - PERCENT) * (F.col(n_a) + F.col(n_b))


def _with_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.count() <= SENT_IDS
    return documents.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, its full set (a 64-bit hash of each shingle, sorted) and the set's parity for the given documents."""

    def work(raw: list[bytes | None], _: pa.RecordBatch) -> dict:
        sets = shingles(raw, width)
        f1, f2 = _prints(sets)
        return {"n": [len(s) for s in sets], "f1": f1, "f2": f2, "bits": _lists(parities(sets)), "shingles": [s.astype("<u8").tobytes() for s in sets]}

    got = map_texts(_with_ids(documents.select("doc_id", "text"), ids), "text", ["doc_id"], work, "n long, f1 long, f2 long, bits array<long>, shingles binary")
    return materialise(got, "sets")


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u8")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            p, q = _unpacked(x), _unpacked(y)
            small, large = (p, q) if len(p) <= len(q) else (q, p)
            at = np.minimum(np.searchsorted(large, small), max(len(large) - 1, 0))
            both = int((large[at] == small).sum()) if len(large) else 0
            ok.append(both > 0 and 100 * both >= PERCENT * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, type=pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A centre with many partners is a join that Spark can split."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y")
    return both.mapInArrow(_confirmed, "a long, b long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of the task: each id with the least id of its component."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = above[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = top(u), top(v)
            above[max(p, q)] = min(p, q)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array([top(x) for x in ids], type=pa.int64())], names=["id", "root"])


def components(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(id, root): the least id of each linked document's component.

    Links are contracted round by round: every document points to its least neighbour, and links between what they point
    to are left. Once at most ``at_once`` links are left, one task of an executor joins them (some 100 MB).
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    roots = None
    while edges.count() > at_once:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("up"))
        jump = up.select(F.col("u").alias("up"), F.col("up").alias("higher"))
        up = materialise(up.join(jump, "up").select("u", F.col("higher").alias("up")), "parents")
        roots = _moved(roots, up.toDF("id", "root"))
        mapped = edges.join(up, "u").select(F.col("up").alias("u"), "v").join(up.select(F.col("u").alias("v"), F.col("up").alias("w")), "v").select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("v"))
        edges = materialise(mapped.where("u != v").distinct(), "edges")
    return _moved(roots, edges.coalesce(1).mapInArrow(_joined, "id long, root long"))


def _moved(roots: DataFrame | None, further: DataFrame) -> DataFrame:
    """(id, root) after a further step (id, root); ids known to either are kept."""
    if roots is None:
        return materialise(further, "roots")
    step = further.select(F.col("id").alias("root"), F.col("root").alias("further"))
    moved = roots.join(step, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    return materialise(moved.unionByName(further.join(roots, "id", "left_anti")), "roots")


def grown(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components after further links (a, b)."""
    if found.isEmpty():
        return roots
    for c in ("a", "b"):
        found = found.join(roots.select(F.col("id").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    return _moved(roots, components(found))


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, f1, packed = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            s = _unpacked(packed[i].as_py()).view(np.int64)
            same = [pa.repeat(c[i], len(s)) for c in (ids, n, f1)]
            yield pa.RecordBatch.from_arrays([*same, pa.repeat(pa.scalar(len(s), pa.int64()), len(s)), pa.array(s)], names=["id", "n", "f1", "held", "key"])


def by_key(rows: DataFrame, total: int, about: DataFrame, size: str, how: str = "inner") -> DataFrame:
    """``total`` rows (key, id, further columns) joined with ``about``, a written table of one row a key with its ``size``.

    The few keys with many rows, sent to all tasks, deal their rows to cells by a hash of the id, and their row of
    ``about`` goes to each cell. So no task gets all rows of a key, and the join does not share a shuffle with the sums.
    """
    edge = max(HOT_ROWS, total // HOT_KEYS)
    cells = F.when(F.col(size) > edge, F.ceil(F.col(size) / F.lit(edge))).otherwise(F.lit(1).cast("long"))
    hot = about.where(F.col(size) > edge).select("key", cells.alias("cells"))
    dealt = rows.join(F.broadcast(hot), "key", "left").withColumn("cell", F.coalesce(F.pmod(F.xxhash64("id", "key"), "cells"), F.lit(0).cast("long"))).drop("cells")
    spread = about.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)))
    return dealt.join(spread.hint("merge"), ["key", "cell"], how).drop("cell")


def rare_keys(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, id, n, room, bits): each set's rarest shingles among the sets of ``ids``, so many that two similar sets share one.

    ``room`` counts the shingle and those that are more frequent in the set: what a pair whose first common shingle this
    is can have in common at most.
    """
    own = sets.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    every = materialise(own.select("doc_id", "n", "f1", "shingles").mapInArrow(_single, "id long, n long, f1 long, held long, key long"), "shingles")
    often = materialise(every.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    place = F.dense_rank().over(Window.partitionBy("id", "f1").orderBy("often", "key"))  # repeated rows share their ranks
    known = by_key(every, every.count(), often, "often", "left").withColumn("often", F.coalesce("often", F.lit(1).cast("long")))
    ranked = known.withColumn("room", F.col("held") - place + 1)
    needed = f"(held * {PERCENT} + 99) div 100"  # shingles that a similar set shares
    rare = ranked.where(f"often > 1 AND room >= {needed}").select("key", "id", "f1", F.col("held").alias("n"), F.col("room").cast("long").alias("room")).distinct()
    bits = own.select(F.col("doc_id").alias("id"), "f1", "bits").distinct()
    return materialise(rare.join(bits.hint("merge"), ["id", "f1"]).drop("f1"), "rare")


def _open(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``held`` in buckets with more than one component, with their root, the bucket's size and its most frequent root."""
    marked = held.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    each = marked.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    buckets = each.groupBy("key").agg(F.max_by("root", "n").alias("major"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("size")).where("roots > 1").drop("roots")
    return materialise(by_key(marked, held.count(), materialise(buckets, "open"), "size"), "marked")


def _met(marked: DataFrame, leads: Column) -> DataFrame:
    """Pairs (a, b) of a leading and any other row of one bucket that are in two components and can be similar.

    A bucket's rows are cut into cells of about ``CELL``; its leading rows go to each cell, so that no bucket is one task's.
    """
    cells = F.ceil(F.col("size") / CELL)
    rows = marked.withColumn("leads", leads).withColumn("cell", F.pmod(F.xxhash64("id", "key"), cells))
    c = rows.where("leads").select("key", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1)).alias("cell"), F.col("id").alias("centre"), F.col("n").alias("centre_n"), F.col("room").alias("centre_room"), F.col("root").alias("own"), *([F.col("bits").alias("centre_bits")] if "bits" in marked.columns else []))
    once = ~F.col("leads") | (F.col("id") > F.col("centre"))  # two leading rows meet once
    new = rows.join(c.hint("merge"), ["key", "cell"]).where((F.col("root") != F.col("own")) & once & _may_link("centre_n", "centre_room", "n", "room"))
    if "bits" in marked.columns:
        new = new.where(_near_bits("centre_n", "centre_bits", "n", "bits"))
    return new.select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def class_components(documents: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, root): components of classes in which every pair of similar candidates is in one."""
    held = members(classes)
    sets = full_sets(documents, held.select(F.col("id").alias("doc_id")).distinct(), width)
    tested = materialise(held.where("centre != id").where(_may_link("centre_n", "centre_n", "n", "n")).select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    roots = components(confirm(tested, sets))

    def further(pairs: DataFrame) -> None:
        nonlocal tested, roots
        new = materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.unionByName(new)
        roots = grown(roots, materialise(confirm(new, sets), "links"))

    held = held.select("key", "id", "n", F.col("n").alias("room"))
    further(_met(_open(held, roots).where(F.col("size") <= SMALL), F.col("root") != F.col("major")))
    large = _open(held, roots).where(F.col("size") > SMALL).select("id").distinct()
    if large.isEmpty():
        return roots
    held = rare_keys(sets, large)
    share = F.least(F.lit(1.0), F.lit(8.0) / F.col("size"))  # some eight rows of each bucket first, which makes components larger
    further(_met(_open(held, roots), F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)))
    further(_met(_open(held, roots), F.col("root") != F.col("major")))
    return roots


def near_duplicates(documents: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id linked with it, directly or not) and kept for every row."""
    s = materialise(signatures(documents, width), "signatures")
    real = s.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(real.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    # rows of one document with different sets belong together
    same = real.groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("low"), F.max(F.struct("f1", "f2", "n")).alias("high")).where("low != high")
    rows = real.select("doc_id", "f1", "f2", "n").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    mixed = rows.join(same.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    root = grown(class_components(documents, classes, width), materialise(mixed.distinct(), "mixed"))
    named = classes.select("f1", "f2", "n", "rep").join(root.withColumnRenamed("id", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("root", "rep").alias("root"))
    linked = real.select("doc_id", "f1", "f2", "n").join(named, ["f1", "f2", "n"], "left").select("doc_id", "n", "root")
    alone = s.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("root"))
    every = linked.unionByName(alone)
    return every.select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("root"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, width: int = 5) -> DataFrame:
    """One row of each component of rows, that of the least id, with its columns as they are.

    Here each row is a document of its own: of rows with one id or none, copies go like any other.
    """
    row = fresh(documents, "row_key")
    keyed = materialise(documents.withColumn(row, F.monotonically_increasing_id()), "keyed")
    linked = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), width).select(F.col("doc_id").alias("key"), "component_id")
    ids = keyed.select(F.col(row).alias("key"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("key")).alias("first"))
    stays = linked.join(ids, "key").groupBy("component_id").agg(F.min("first")["key"].alias("key"))
    gone = materialise(linked.select("key").join(stays.select("key"), "key", "left_anti").withColumnRenamed("key", row), "gone")
    small = gone.count() <= SENT_IDS
    return keyed.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*[f"`{c}`" for c in documents.columns])


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 2)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
                      ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM w),
sized AS (SELECT doc_id, len(shingles) AS n FROM s),
one AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
ranked AS (
  SELECT o.doc_id, z.n, row_number() OVER (PARTITION BY o.doc_id ORDER BY f.n, o.shingle) AS place, o.shingle
  FROM one o JOIN (SELECT shingle, count(*) AS n FROM one GROUP BY 1) f USING (shingle) JOIN sized z USING (doc_id)),
prefix AS (SELECT doc_id, n, shingle FROM ranked WHERE place <= n - (8 * n + 9) // 10 + 1),
cand AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM prefix x JOIN prefix y USING (shingle) WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
inter AS (SELECT a, b, len(list_intersect(x.shingles, y.shingles)) AS k, len(x.shingles) + len(y.shingles) AS total FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b),
link AS (SELECT a, b FROM inter WHERE 100 * k >= 80 * (total - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, a AS root FROM edge UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(r.root, d.doc_id)) AS component_id, least(d.doc_id, coalesce(r.root, d.doc_id)) = d.doc_id AS kept
FROM sized d LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY 1) r USING (doc_id)
"""
