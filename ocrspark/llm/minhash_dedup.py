"""Near-duplicate texts: MinHash bands, odd sketches, exact confirmation, components.

A text is the set of its word shingles. Texts with equal sets form a class and go on as one.
MinHash samples are cut into bands; classes that share a band meet. The samples are also folded
into an odd sketch, a bitmap in which every (position, sample) flips one bit: the bits in which
two sketches differ estimate how many samples differ, most precisely where few do. Pairs whose
estimate lies clearly below the threshold are left out, all others are confirmed on full sets.

Links are found in two passes, so that a large group does not emit its pairs. The first takes a
spanning choice per bucket and confirms it. The second looks at every pair that is similar by its
sketch and still lies in different components: the sets of such texts come together in bounded
units of their buckets, are confirmed there, and only a spanning set of links comes out. So no
link between components is lost, and what is shuffled grows with the texts and not with the pairs.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ocrspark.llm import groups, shingles
from ocrspark.llm.common import U64, binary_rows, mix, rows_of, same, session, slices, stored, text_prints
from ocrspark.llm.components import connected_components

#: Bands of four samples: a pair at 0.75 shares none with probability 5e-6.
BANDS, PER_BAND = 32, 4
SAMPLES = BANDS * PER_BAND
SKETCH_BITS = 512
#: Deviations of the sketch estimate that a pair may lie below the threshold and still be confirmed.
SLACK = 5.0
SEED = 29
#: Columns of a membership matrix that are held at a time.
COLUMNS = 4096
#: Shingles hashed at a time, so that a long text needs no more memory than a short one.
CHUNK = 4096


def _minhash(values: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, 2**32 - 1, np.uint32)
    low = (values >> U64(32)).astype(np.uint32)
    for k in range(0, len(low), CHUNK):
        np.minimum(best, (factors[:, None] * low[k : k + CHUNK] + shifts[:, None]).min(axis=1), out=best)
    return best


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the (position, sample) pairs of every row."""
    n, k = samples.shape
    at = mix(samples.astype(U64) + (np.arange(k, dtype=U64) << U64(32))) % U64(bits)
    flat = (np.arange(n)[:, None] * bits + at.astype(np.int64)).ravel()
    return np.packbits((np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits), axis=1)


def similarity(differing: np.ndarray, bits: int = SKETCH_BITS, samples: int = SAMPLES) -> np.ndarray:
    """Estimated Jaccard similarity for a count of differing bits."""
    share = np.minimum(2.0 * differing / bits, 1 - 1e-9)
    return 1 + bits / (4.0 * samples) * np.log1p(-share)


def most_differing(threshold: float) -> int:
    """Largest count of differing bits at which a pair is still confirmed."""
    deviation = (threshold * (1 - threshold) / SAMPLES) ** 0.5 + 0.012
    ok = similarity(np.arange(SKETCH_BITS + 1)) >= threshold - SLACK * deviation
    return int(np.flatnonzero(ok)[-1])


def _signed(batches, n: int):
    rng = np.random.default_rng(SEED)
    factors = rng.integers(0, 2**32, SAMPLES, np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 2**32, SAMPLES, np.uint32)
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles.sets(batch.column("text"), n)
            full = [k for k, s in enumerate(sets) if len(s)]
            samples = np.zeros((len(sets), SAMPLES), np.uint32)
            prints = np.zeros((len(sets), 2), U64)
            for k in full:
                s = sets[k]
                samples[k] = _minhash(s, factors, shifts)
                prints[k] = mix(s + U64(1)).sum(dtype=U64), mix(s ^ U64(0x5555555555555555)).sum(dtype=U64)
            bands = np.zeros((len(sets), BANDS), U64)
            for j in range(PER_BAND):
                bands = mix(bands * shingles.STEP + samples[:, j::PER_BAND] + U64(j))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), batch.column("t1"), batch.column("t2"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)),
                    binary_rows(odd_sketches(samples)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                ],
                ["id", "t1", "t2", "n", "p1", "p2", "sketch", "bands"],
            )


def _sets(batches, n: int):
    """Sets of the texts that a class is to be confirmed by."""
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingles.sets(batch.column("text"), n)
            prints = np.array([
                (mix(s + U64(1)).sum(dtype=U64), mix(s ^ U64(0x5555555555555555)).sum(dtype=U64)) for s in sets
            ], U64).view(np.int64)
            right = np.flatnonzero(
                (prints[:, 0] == batch.column("p1").to_numpy()) & (prints[:, 1] == batch.column("p2").to_numpy())
            )
            ends = np.r_[0, np.cumsum([len(sets[k]) for k in right])].astype(np.int32)
            values = np.concatenate([sets[k] for k in right] or [np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(pa.array(right)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                ["node", "shingles"],
            )


def _similar(t: pa.Table, most: int):
    """Index pairs of different parts within the units of a table whose sketches are close."""
    part, unit, home = (t[c].to_numpy() for c in ("part", "unit", "home"))
    across = t["across"].to_numpy(zero_copy_only=False)
    sketch = rows_of(t["sketch"], U64, SKETCH_BITS // 64)

    def near(i, j):
        ok = part[i] != part[j]
        ok[ok] = np.bitwise_count(sketch[i[ok]] ^ sketch[j[ok]]).sum(axis=1, dtype=np.int64) <= most
        return ok

    def dense(a, b):
        out = np.zeros((len(a), len(b)), np.int16)
        for w in range(sketch.shape[1]):
            out += np.bitwise_count(sketch[a, w][:, None] ^ sketch[b, w][None, :])
        return (out <= most) & (part[a][:, None] != part[b][None, :])

    found = list(groups.pairs(unit, across, home, near, dense))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)


def _chosen(batches, most: int):
    """For each row of a unit its meeting with the earliest row it is similar to, and one to a later row."""
    for t in groups.by_unit(batches):
        i, j = _similar(t, most)
        a, b = np.minimum(i, j), np.maximum(i, j)
        keep = np.unique(np.r_[
            np.lexsort((a, b))[np.unique(np.sort(b), return_index=True)[1]],
            np.lexsort((b, a))[np.unique(np.sort(a), return_index=True)[1]],
        ])
        node = t["node"].to_numpy()
        x, y = node[a[keep]], node[b[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _open(batches, most: int):
    """Rows of units that are similar to a row of another part."""
    for t in groups.by_unit(batches):
        i, j = _similar(t, most)
        rows = pa.array(np.unique(np.r_[i, j]))
        yield from t.select(["unit", "across", "home", "node"]).take(rows).combine_chunks().to_batches()


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of all sets.

    Members that lie in one set only are left out; the others are the columns of a matrix of zeros
    and ones, which is multiplied by itself a stretch of columns at a time.
    """
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count > 1
    number = np.cumsum(many) - 1
    keep = many[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(many.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        members = np.zeros((len(sets), COLUMNS), np.float32)
        members[row[a:b], column[a:b] - start] = 1
        out += (members @ members.T).astype(np.int64)
    return out


def _exact(batches, percent: int):
    """A spanning set of the links between different parts within each unit, by full sets."""
    for t in groups.by_unit(batches):
        unit, node, part, home = (t[c].to_numpy() for c in ("unit", "node", "part", "home"))
        across = t["across"].to_numpy(zero_copy_only=False)
        lists = t["shingles"].combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        out = []
        for s, e in zip(starts.tolist(), np.r_[starts[1:], len(unit)].tolist()):
            sizes = np.diff(ends[s : e + 1]).astype(np.int64)
            both = shared([values[ends[k] : ends[k + 1]] for k in range(s, e)])
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            linked &= part[s:e][:, None] != part[s:e][None, :]
            if across[s]:
                linked &= home[s:e][:, None] != home[s:e][None, :]
            root = groups.roots(e - s, *np.nonzero(np.triu(linked, 1)))
            out.append((s + np.flatnonzero(root != np.arange(e - s)), s + root[root != np.arange(e - s)]))
        i, j = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], ["a", "b"])


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, block: int = 512
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``df``.

    Two texts are linked when 100 * shared >= ``percent`` * all distinct shingles of ``n`` words.

    - A null, empty or blank text has no shingle and links with nothing. A text of fewer than
      ``n`` words has one shingle, its whole sequence.
    - ``component_id`` is the least id that is not null in a component, ``kept`` marks rows with
      that id; a text without shingles is its own component. Rows that share an id are one
      document: all or none of them are kept. A row with a null id gets the component of the
      texts it links with, and a null component, kept, when it has no partner with an id
      (:func:`copies` tells such rows apart).
    - Texts of any length are handled whole. Other columns are ignored; an empty table gives an
      empty result.
    """
    out = _components(df, id_col, text_col, n, percent, block)
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, block: int = 512
) -> DataFrame:
    """``(id, t1, t2)`` of the rows of ``df`` to drop, so that each component keeps one document.

    The document with the least id stays, and in a component without any id the text whose print
    (``t1``, ``t2``, see ``text_prints``) is least. Equal texts without an id have one print, so
    they are dropped or kept together.
    """
    out = _components(df, id_col, text_col, n, percent, block)
    stays = F.when(F.col("component_id").isNull(), F.col("t1").eqNullSafe(F.col("least_t1"))).otherwise(
        F.col("id").eqNullSafe(F.col("component_id"))
    )
    return out.where("n > 0").where(~stays).select("id", "t1", "t2").distinct()


def _components(df: DataFrame, id_col: str, text_col: str, n: int, percent: int, block: int) -> DataFrame:
    """``(id, t1, t2, n, component_id, least_t1)`` of every row, with the print of texts without an id."""
    spark = session(df.sparkSession)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    t1, t2 = text_prints(F.col("id"), F.col("text"))
    texts = texts.select("id", t1.alias("t1"), t2.alias("t2"), "text")
    signed = stored(
        texts.mapInArrow(
            partial(_signed, n=n), "id long, t1 long, t2 long, n long, p1 long, p2 long, sketch binary, bands array<long>"
        ), "signed",
    )
    classes = stored(
        signed.where("n > 0").groupBy("p1", "p2")
        .agg(F.min("id").alias("id"), F.min("t1").alias("t1"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "*"), "classes",
    )
    keys = classes.select(F.posexplode("bands").alias("band", "code"), "node")
    met = stored(
        groups.units(keys, ["band", "code"], block, "bands").select("unit", "across", "home", "node"), "meetings"
    )
    most = most_differing(percent / 100)
    # a text is found by its id or, in a class without one, by its print: null ids do not all meet
    told = F.when(F.col("id").isNull(), F.col("t1")).alias("t1")
    nodes = stored(met.select("node").distinct().join(classes.select("node", "id", told, "p1", "p2"), "node"), "met")
    # one plan at every size: what is broadcast for few texts would be shuffled for many
    wanted = texts.join(nodes.hint("merge"), same(texts, nodes, "id", "t1")).select("node", "p1", "p2", "text")
    found = stored(
        wanted.mapInArrow(partial(_sets, n=n), "node long, shingles array<long>").dropDuplicates(["node"]), "sets"
    )

    def by_unit(rows: DataFrame) -> DataFrame:
        return rows.repartition(tasks, "unit").sortWithinPartitions("unit")

    sketched = met.join(classes.select("node", "sketch"), "node")
    pairs = by_unit(sketched.withColumn("part", F.col("node"))).mapInArrow(partial(_chosen, most=most), "a long, b long")
    half = stored(pairs.distinct(), "chosen").join(
        found.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a"
    )
    full = half.join(found.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
    both = F.size(F.array_intersect("left", "right"))
    links = stored(
        full.select("a", "b", both.alias("both"), (F.size("left") + F.size("right") - both).alias("either"))
        .where(F.expr(f"100L * both >= {percent}L * either")).select("a", "b"), "links",
    )
    parts = stored(connected_components(links).withColumnRenamed("component", "part"), "parts")

    def with_part(rows: DataFrame) -> DataFrame:
        return rows.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))

    unit = "unit long, across boolean, home int, node long"
    left = stored(by_unit(with_part(sketched)).mapInArrow(partial(_open, most=most), unit), "open")
    late = by_unit(with_part(left.join(found, "node"))).mapInArrow(partial(_exact, percent=percent), "a long, b long")
    late = stored(late.distinct(), "late-links")
    # the parts found so far are links too, and fewer than those they came from
    joined = parts.select(F.col("node").alias("a"), F.col("part").alias("b")).unionAll(late)
    parts = stored(connected_components(joined).withColumnRenamed("component", "part"), "late-parts")
    placed = classes.select("node", "id", "t1", "p1", "p2").join(parts, "node", "left")
    placed = stored(placed.withColumn("part", F.coalesce("part", "node")), "placed")
    least = stored(
        placed.groupBy("part").agg(F.min("id").alias("component_id"), F.min("t1").alias("least_t1")), "least"
    )
    named = stored(placed.join(least, "part").select("p1", "p2", "component_id", "least_t1"), "named")
    full, bare = signed.where("n > 0"), signed.where("n = 0")
    return full.join(named, ["p1", "p2"]).select("id", "t1", "t2", "n", "component_id", "least_t1").unionAll(
        bare.select("id", "t1", "t2", "n", F.col("id").alias("component_id"), F.col("t1").alias("least_t1"))
    )
